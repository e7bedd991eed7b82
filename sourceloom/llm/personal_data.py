"""Personal data: base patterns, plus spans that boosted trees choose among loose proposals, in DataFrame functions only.

Generators propose spans: the four base patterns, whether their match is valid or not, looser spellings of the same kinds and
digit fragments.  Proposals overlap.  Trees over format and context features learn from base matches and fragments (valid
ones are positive, also in a loose spelling of the same kind; those that fail their check are negative, and so are fragments that
touch neither a valid match nor a loose proposal, as they might be part of one), counted over all documents into at most a few thousand
distinct feature rows, which is all that reaches the driver.  A threshold is calibrated on a fifth of the documents that
the trees have not seen.  Loose proposals above it that touch no base span are added; base spans always stay.

Texts are read once.  What leaves the scan is one row a text with its matches, their lengths and the gaps before them; offsets
are running sums over a text's matches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm import boosting
from sourceloom.session import Workspace

KINDS = ["email", "ip", "card", "phone"]
# Equal to the plain patterns with greedy quantifiers, but in time linear in the text: runs are entered at their start only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|@)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
FRAGMENT = r"[0-9][0-9.-]*+"
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
LOOSE_SIGNS = {"email": r"(?i)[\[(](?:at|@)[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][._/][0-9]", "phone": r"[0-9]\)?[\x20.-][0-9]"}
PRECISION = 0.98
CONTEXT = 24


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 1 to 40 digits pass the check: from the right, every second digit is doubled and its digits are summed."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: Column, span: Column) -> Column:
    count, octet = F.length(_digits(span)), r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    card = F.when(count.between(13, 19), luhn(_digits(span))).otherwise(False)
    return (F.when(kind == "email", True).when(kind == "ip", span.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", card).otherwise(count.between(9, 15)))


def _respelled(kind: Column, span: Column) -> Column:
    """A valid base match as the loose patterns spell its kind, null if they cannot."""
    national = F.regexp_replace(span, r"^\+[0-9]{1,3}[\x20.-]", "")
    card = F.regexp_replace(_digits(span), r"^([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})$", "$1.$2.$3.$4")
    return (F.when(kind == "email", F.regexp_replace(span, "@", " [at] ")).when((kind == "card") & (F.length(_digits(span)) == 16), card)
            .when((kind == "phone") & national.rlike(f"^{LOOSE['phone']}$"), national))


def _matches(text: Column, source: str, kind: str, pattern: str, sign: str) -> Column:
    """Array of matches with the gaps around them; empty without looking further if the sign is missing."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, 2147483647).alias("next"))
    cut = F.transform(pieces, lambda p, i: F.struct(
        F.lit(source).alias("source"), F.lit(kind).alias("kind"), i.alias("nth"), p["hit"].alias("span"),
        F.length(p["gap"]).alias("gap"), F.right(p["gap"], F.lit(CONTEXT)).alias("before"), F.left(p["next"], F.lit(CONTEXT)).alias("after")))
    kept = F.filter(cut, lambda m: m["span"].isNotNull())
    none = F.array().cast("array<struct<source:string,kind:string,nth:int,span:string,gap:int,before:string,after:string>>")
    return F.when(text.rlike(sign), kept).otherwise(none)


def _side(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"^\s$"), 0).when(char.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(1)


def _features(kind: Column, span: Column, before: Column, after: Column) -> dict[str, Column]:
    digits = F.length(_digits(span))
    signs = F.length(F.regexp_replace(span, r"[\p{L}\p{N}]", ""))
    bucket = lambda c, *bounds: sum((F.when(c >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return {
        "f_kind": F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int"),
        "f_digits": bucket(digits, 7, 9, 12, 13, 16, 20),
        "f_signs": bucket(signs, 1, 2, 3, 5),
        "f_check": F.when(digits.between(12, 19), luhn(_digits(span)).cast("int")).otherwise(0),
        "f_octets": span.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$").cast("int"),
        "f_plus": span.startswith("+").cast("int"),
        "f_domain": span.rlike(r"(?i)[.\])]\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$").cast("int"),
        "f_word": before.rlike(r"(?i)\b(?:e-?mail|mail|phone|tel|call|fax|mobile|card|visa|ip|address|contact)\b").cast("int"),
        "f_left": _side(F.right(before, F.lit(1))),
        "f_right": _side(F.left(after, F.lit(1))),
    }


def personal_data(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """Per row: id, base and spans: arrays of (kind_no, kind, start, end, span), by kind as listed, then start.

    Offsets count code points, the end excluded.  Null text counts as empty.  Repeated rows and null ids are rows of their own.
    Other columns are not read.  Empty tables give empty results; without base matches nothing is learned or added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), text.alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(f"b_{kind}", _matches(F.col("text"), "base", kind, BASE[kind], SIGNS[kind]))
        rows = rows.withColumn(f"l_{kind}", _matches(F.col("text"), "loose", kind, LOOSE[kind], LOOSE_SIGNS[kind]))
    rows = rows.withColumn("fragments", _matches(F.col("text"), "fragment", "phone", FRAGMENT, "[0-9]"))
    parts = [f"{s}_{k}" for k in KINDS for s in "bl"] + ["fragments"]
    found = ws.save(rows.select("uid", "id", F.concat(*parts).alias("matches")))

    one = found.select("uid", F.explode_outer("matches").alias("m")).where("m IS NOT NULL").select("uid", "m.*")
    size = F.length("span")
    before = Window.partitionBy("uid", "source", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum(F.col("gap") + size).over(before) - size).cast("bigint")
    valid = (F.col("source") == "base") & _valid(F.col("kind"), F.col("span"))
    placed = one.select("uid", "source", "kind", "span", "before", "after", start.alias("start"), (start + size).alias("end"), valid.alias("valid"))
    forms = F.array(F.struct("source", "span"), F.struct(F.lit("respelled").alias("source"), F.when(F.col("valid"), _respelled(
        F.col("kind"), F.col("span"))).alias("span")))
    placed = placed.withColumn("form", F.explode_outer(F.filter(forms, lambda f: f["span"].isNotNull()))).drop("source", "span").select("*", "form.*")
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    proposals = ws.save(placed.select("uid", "source", "kind", kind_no.alias("kind_no"), "start", "end", "span", "valid",
                                      *[c.alias(k) for k, c in _features(*map(F.col, ("kind", "span", "before", "after"))).items()]))
    names = [c for c in proposals.columns if c.startswith("f_")]
    base = proposals.where("valid AND source = 'base'")

    # distinct feature rows are bounded by the product of the features' values
    fold = (F.pmod(F.xxhash64("uid"), F.lit(5)) == 0).alias("held_out")
    order = Window.partitionBy("uid").orderBy("start")
    shield = (F.col("source") == "loose") | F.col("valid")
    reach = F.max(F.when(shield, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    # growing frames only: a text may have very many fragments
    ahead = F.min(F.when(shield, F.col("start"))).over(Window.partitionBy("uid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    doubtful = (F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
    labelled = proposals.withColumn("doubtful", doubtful).where("source <> 'loose' AND NOT (source = 'fragment' AND doubtful)")
    learned = labelled.groupBy(fold, *names).agg(
        F.sum(F.col("valid").cast("bigint")).alias("positive"), F.count(F.lit(1)).alias("total")).collect()
    table = lambda side: tuple(np.array([[r[c] for c in cols] for r in learned if r["held_out"] is side], float).reshape(-1, len(cols))
                               for cols in (names, ["positive", "total"]))
    (x, y), (x_out, y_out) = table(False), table(True)
    spans = base.select("uid", "kind_no", "kind", "start", "end", "span")
    if len(y) and y[:, 0].sum() and len(y_out):
        model = boosting.fit(x, y[:, 0], y[:, 1])
        cut = boosting.threshold(boosting.score_rows(x_out, *model), y_out[:, 0], y_out[:, 1], precision)
        loose = proposals.where("source = 'loose'").withColumn("score", boosting.score([F.col(n) for n in names], *model)).where(F.col("score") >= cut)
        near = base.select("uid", "kind_no", "kind", "start", "end", "span", F.lit(True).alias("is_base")).union(
            loose.select("uid", "kind_no", "kind", "start", "end", "span", F.lit(False).alias("is_base")))
        reach = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
        ahead = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
        touching = (F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
        added = near.withColumn("touching", touching).where("NOT is_base AND NOT touching").select(*spans.columns).distinct()
        spans = spans.union(added)
    as_rows = lambda df, name: df.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("kind_no", "start", "end", "kind", "span"))).alias(name))
    result = found.select("uid", "id").join(as_rows(base, "base"), "uid", "left").join(as_rows(spans, "spans"), "uid", "left")
    empty = F.array().cast(result.schema["base"].dataType)
    return result.select(F.col("id").alias(id_col), F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
