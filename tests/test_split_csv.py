"""CSV files read in ranges give the rows of the serial reader."""

import csv
import random

import pytest

from case_insights.sources import split_csv
from case_insights.sources.schema import NARRATIVE, read_narratives_csv
from case_insights.sources.split_csv import read_csv_in_ranges


@pytest.fixture
def ranges(spark):
    keys = ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")
    before = {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in keys}

    def set_(size):
        for k, v in zip(keys, (f"{size}b", "0", "1")):
            spark.conf.set(f"spark.sql.files.{k}", v)

    yield set_
    for k, v in before.items():
        spark.conf.unset(f"spark.sql.files.{k}") if v is None else spark.conf.set(f"spark.sql.files.{k}", v)


def serial(spark, path):
    return rows(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def rows(df):
    return sorted(map(str, df.collect()))


def write(path, records, ending="\n", last=True):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=ending).writerows(records)
    if not last:
        text = open(path, newline="").read()
        open(path, "w", newline="").write(text.removesuffix(ending))


def field(rng):
    parts = ["word", '"', ",", "\n", "\n\n", " ", "é", "", "\t", "''"]
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 8, 60])))


@pytest.mark.parametrize("seed", range(3))
def test_random_files(spark, tmp_path, ranges, seed):
    rng = random.Random(seed)
    # the serial reader takes the first line break it sees for the file's line end
    header = ["narrative", "the `other` one" if seed == 2 else "the `other`\none"]
    path = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        records = [header, *([field(rng), rng.choice(["1", field(rng)])] for _ in range(25))]
        ending = "\r\n" if seed == 2 else "\n"
        write(f"{path}/{name}", records, ending, last=seed % 2 == 0)
    want = serial(spark, path)
    for size in (17, 200, 100_000):
        ranges(size)
        assert rows(read_csv_in_ranges(spark, path)) == want, size


def test_odd_files(spark, tmp_path, ranges):
    texts = {
        "no rows": "a,b\n", "no line end": 'a,b\n"x\ny",1', "blank lines": "a,b\n\n1,2\n\n\n3,4\n", "one column": "a\nx\n\"y\nz\"\n",
        "uneven": 'a,b\n1\n"1\n2",3,4\n,\n"",x\n', "break ends": 'a,b\n"x\n",1\n"\ny","\n"\n', "long": 'a,b\n"' + "x\n" * 500 + '",1\nz,2\n',
    }
    for name, text in texts.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        want = serial(spark, str(path))
        for size in (5,):
            ranges(size)
            assert rows(read_csv_in_ranges(spark, str(path))) == want, (name, size)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    path = str(tmp_path / "a.csv")
    write(path, [["narrative", "n"], *([f'He said "no {i}",\nand left', i] for i in range(2000))])
    ranges(4096)
    whole = split_csv.csv_records(spark, path)
    assert whole.rdd.getNumPartitions() > 10
    got = read_narratives_csv(spark, path)
    assert {r[NARRATIVE] for r in got.collect()} == {f'He said "no {i}",\nand left' for i in range(2000)}
    assert rows(got) == rows(read_narratives_csv(spark, path, in_ranges=False))
    assert got.count() == got.select("id").distinct().count() == 2000
    typed = read_csv_in_ranges(spark, path, "text string, n int")
    assert typed.agg({"n": "sum"}).first()[0] == sum(range(2000))


def test_too_many_ranges_for_a_broadcast(spark, tmp_path, ranges, monkeypatch):
    rng = random.Random(9)
    path = str(tmp_path / "a.csv")
    write(path, [["a", "b"], *([field(rng), field(rng)] for _ in range(60))])
    want = serial(spark, path)
    monkeypatch.setattr(split_csv, "BROADCAST_RANGES", 0)
    ranges(30)
    assert rows(read_csv_in_ranges(spark, path)) == want


def test_sizes():
    assert [split_csv._bytes(s) for s in ("128MB", "134217728b", "134217728", "16k", "1g")] == [1 << 27] * 3 + [1 << 14, 1 << 30]
