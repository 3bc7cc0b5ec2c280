"""The pipeline's stages, each against its operator's own decisions, and their edge cases."""

import ctypes
import os
import re
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import common, jaccard_join, quality_rules, secret_scan, toxicity

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_follow_each_other(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        held[name] = before, docs
    before, after = held["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids(after) == ids(toxicity.score(before, model).filter("predicted = 0"))
    before, after = held["quality_rules"]
    assert ids(after) == ids(quality_rules.judge(before).filter("kept"))
    before, after = held["near_duplicates"]
    assert ids(after) <= ids(before) and after.join(before, "text", "left_semi").count() == after.count() == len(ids(after))
    _, after = held["secret_scans"]
    assert secret_scan.scan(after).filter("n_access + n_hex > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, after, FOLDER)
    assert ids(packed) == ids(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 5000, "en", None, None), (3, "a b c d e f g h", None, "s", 15), (3, "a b c d e f g h", None, "s", 15)]])
def test_stage_edges(spark, rows, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("node", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).collect()


def test_an_idle_worker_holds_no_freed_memory(monkeypatch):
    """Stages share their workers: what a task has freed must not stay with its worker beside the next stage's memory."""
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("this C library keeps no freed memory, or does not give it back")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
    peak, last = [], []

    class Rows:
        sparkSession = None

        def mapInArrow(self, fn, schema):
            return fn

    def task(slices):
        for (ids,) in slices:
            texts = [bytes(1500) for _ in range(100_000)]
            last.append(bytes(1500))  # lies behind the others: they are not at the end of the heap
            peak.append(held())
            del texts
            yield [(i,) for i in ids]

    monkeypatch.setattr(common, "ship", lambda spark: None)
    run = common.stream_task(Rows(), task, "i long")
    assert [b.to_pydict() for b in run(iter([pa.RecordBatch.from_pydict({"i": [1, 2]})]))] == [{"i": [1, 2]}]
    assert held() < peak[0] - 100


def test_packing_starts_no_threads():
    """A task has one core; threads of the tokenizers library take those of others, and each keeps memory."""
    code = """
import os, public_tokenizers
from brindle.llm import packing
encode = packing.TokenizerChunks(public_tokenizers.path("byte_bpe_50k.json"))
before = len(os.listdir("/proc/self/task"))
encode([f"some text {i} of words" for i in range(2000)])
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.split() == ["0"]


def test_batches_are_bounded_unless_the_session_sets_them(spark):
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": common.BATCH_ROWS, "spark.sql.parquet.columnarReaderBatchSize": common.READER_ROWS}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.unset(k)
        common.ship(spark)
        assert {k: spark.conf.get(k) for k in names} == {k: str(v) for k, v in names.items()}
        for k in names:
            spark.conf.set(k, 77)
        common.ship(spark)
        assert {spark.conf.get(k) for k in names} == {"77"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_links_of_many_tasks_are_few_files(spark, monkeypatch):
    """Hadoop starts processes for each local file, and each counts the executor's memory again until it runs its program."""
    files = {}

    def spy(df, tag, **more):
        out = common.cut(df, tag, **more)
        files.setdefault(tag, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "cut", spy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        words = [f"w{i}" for i in range(60)]
        docs = [(2 * i + j, " ".join([f"own{i}", *(f"{w}_{i}" for w in words), *["last"] * j])) for i in range(60) for j in range(2)]
        rows = jaccard_join.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i - i % 2 for i, _ in docs}
    assert max(files["links"]) <= 2
