"""The splittable CSV reader against the reader that takes a file in one task."""

import random

import pytest

from autostat.sources import csv_records
from autostat.sources.tables import read_csv, read_table

CELLS = ["", "1", "-2.5", "plain", "a,b", 'say "hi"', "two\nlines", 'x\n"y",\n\n z', "\n", '"', "  spaced ", "é中", 'a"b', "NA", "\r\n", "long " * 30]


def written(path, rows, rng, end="\n"):
    def cell(v):
        must = any(c in v for c in ',"\n\r') or (v != v.strip())
        return '"' + v.replace('"', '""') + '"' if must or rng.random() < 0.3 else v

    text = "id,a,b\n" + "".join(f"{i},{cell(a)},{cell(b)}{end}" + ("\n" if rng.random() < 0.05 else "") for i, (a, b) in enumerate(rows))
    path.write_bytes(text.encode())
    return text


@pytest.fixture
def small_ranges(spark):
    for k, v in (("maxPartitionBytes", "97"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_same_rows_by_ranges(spark, tmp_path, small_ranges, seed, end):
    rng = random.Random(seed)
    for name in ("one", "two"):
        written(tmp_path / f"{name}.csv", [(rng.choice(CELLS), rng.choice(CELLS)) for _ in range(150)], rng, end)
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path))
    found = csv_records.records(spark, f"{tmp_path}/one.csv")
    assert found.rdd.getNumPartitions() > 10
    schema = "id string, a string, b string"
    ours = read_csv(spark, str(tmp_path), schema)
    # The other reader leaves the carriage return of a line end in an unquoted last cell.
    bare = lambda v: v[:-1] if v and v.endswith("\r") and v[:-1] in CELLS else v
    want = [tuple(None if v in ("", "NA") else v for v in (i, a, bare(b))) for i, a, b in map(tuple, whole.collect())]
    key = lambda r: repr(r)
    assert sorted(map(tuple, ours.collect()), key=key) == sorted(want, key=key)
    assert read_table(spark, f"{tmp_path}/one.csv").dtypes[0] == ("id", "bigint")


def test_edges(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,x\n')
    assert csv_records.records(spark, f"{tmp_path}/open.csv").count() == 1
    (tmp_path / "head.csv").write_text('"a\nb",c\n')
    assert read_csv(spark, f"{tmp_path}/head.csv", "x string, y string").count() == 0
    (tmp_path / "last.csv").write_text("a,b\n1,2")
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/last.csv").collect()] == [(1, 2)]
    cell = "\n".join('quote "" here, and there' for _ in range(60))
    (tmp_path / "long.csv").write_text(f'a,b\n1,"{cell}"\n2,x\n')
    rows = read_csv(spark, f"{tmp_path}/long.csv").orderBy("a").collect()
    assert [r["b"] for r in rows] == [cell.replace('""', '"'), "x"]
    assert read_csv(spark, f"{tmp_path}/last.csv", quoted_newlines=False).count() == 1


@pytest.mark.parametrize(("line", "outside", "inside"), [
    ("a,b", False, True), ('a,"b', True, False), ('"a,b"', False, True), ('a""b', False, True), ('","', False, True), ('"a""', True, True),
    ('x"', False, False), ('","x', False, True), ('""', False, True), ('a"b,c', False, False), ('"",""",', True, False),
])
def test_states(line, outside, inside):
    assert csv_records.inside_after(line, False, ",") == outside


def test_states_inside():
    assert csv_records.inside_after("still open", True, ",") and csv_records.inside_after('a"" b', True, ",")
    assert not csv_records.inside_after('end",x', True, ",") and csv_records.inside_after('end","x', True, ",")
