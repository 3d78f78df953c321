"""One file in many blocks, cut at every position, against the reader of whole documents."""

import random

import pytest

from tidemark.sources import csv_files, split_csv

FILES = {
    "plain": b"id,name\n1,a\n2,\"b, c\"\n\n3,d\n",
    "wide": "﻿id,té xt\r\n1,\"line one\r\nline \"\"two\"\"\r\n\r\nend\"\r\n2,é\r\n\"3\n\",\"\n\n\"\n".encode(),
    "returns": b"a,b\r1,2\r\"3\r4\",5\r",
    "ragged": b"a,b\n1,2\n\n1,\"x\ny\"\n3\n4,5,6\n",
    "inside": b"a,b\n1,\"x\ny\"\n2,z\"q\"\n3,4\n",
    "after": b"a,b\n\"1\"x,2\n",
    "open": b"a,b\n1,\"never\n2,3\n",
    "twice": b"a,A \n1\n",
    "bytes": b"a,b\n1,\xff\n",
}


def rows(df):
    return sorted(((r.path.rsplit("/", 1)[-1], r.row_id or 0, tuple(r.headers or ()), tuple(r.cells or ()), r.error is not None) for r in df.collect()), key=repr)


def errors(df):
    return {r.path.rsplit("/", 1)[-1]: r.error for r in df.where("error IS NOT NULL").collect()}


@pytest.fixture
def blocks_of(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 0)
        spark.conf.set(keys[2], 1)

    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size", [1000, 7, 3, 1])
def test_any_cut(spark, tmp_path, blocks_of, size):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    want = csv_files.read_documents(spark, str(tmp_path))
    expected, told = rows(want), errors(want)
    blocks_of(size)
    got = split_csv.read_documents(spark, str(tmp_path))
    assert rows(got) == expected
    assert {k: v for k, v in errors(got).items() if k not in ("bytes", "open")} == {k: v for k, v in told.items() if k not in ("bytes", "open")} and "never closed" in errors(got)["open"]
    if size == 1:
        assert split_csv.blocks(split_csv._lines(spark, str(tmp_path / "wide"))).count() > 6


def test_random_documents(spark, tmp_path, blocks_of):
    rng = random.Random(8)
    for i in range(12):
        body = "".join(rng.choice(["a", "é", ",", '"', '""', "\n", "\r\n", "x,y\n", '"q\nr",s\n', "1,2\n"]) for _ in range(60))
        (tmp_path / f"f{i}").write_bytes(("h1,h2\n" + body).encode())
    want = csv_files.read_documents(spark, str(tmp_path))
    expected, told = rows(want), errors(want)
    blocks_of(16)
    got = split_csv.read_documents(spark, str(tmp_path))
    assert rows(got) == expected
    never = lambda e: {k: v for k, v in e.items() if "never closed" not in v}
    assert all(v == told[k] for k, v in never(errors(got)).items()) and errors(got).keys() == told.keys()
