"""Symbol operators on files of a megabyte: the time may grow with the size, not with its square."""

import time

from conftest import one_file
from sourceloom.operators import symbols


def python_file(n):
    filler = "# a line of filler text\n" * 20
    return "".join(
        f'from a.b{i} import (\n    c,\n    d as e,\n)\ndef f{i}(a: int, b) -> str:\n    """Doc {i}."""\n    return {i}\n{filler}' for i in range(n))


def test_functions_and_imports_of_a_large_file(spark):
    seconds = {}
    for n in (100, 2000):
        file = one_file(spark, python_file(n), "python").cache()
        start = time.monotonic()
        found = symbols.functions(file).select("name", "docstring", "line").collect()
        names = symbols.python_imports(file).count()
        seconds[n] = time.monotonic() - start
        assert {(f.name, f.docstring) for f in found} == {(f"f{i}", f"Doc {i}.") for i in range(n)} and names == 2 * n
    assert seconds[2000] < 30
