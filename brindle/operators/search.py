"""Full-text search over a token table (term, doc, col, pos). Queries are joins and aggregations; nothing is held on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(df: DataFrame, key: str, columns: list[str], stop_words: frozenset[str] = frozenset(), prefix: int = 0) -> DataFrame:
    """Lower-case alphanumeric runs of 1 to 100 characters with their positions. prefix > 0 keeps only so many characters."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("[a-z0-9]+"), 0).alias("words")) for c in columns]))
    t = df.select(F.col(key).alias("doc"), parts.alias("x")).select("doc", "x.col", F.posexplode("x.words").alias("pos", "term"))
    t = t.filter(F.length("term") <= 100)
    if stop_words:
        t = t.filter(~F.col("term").isin(*sorted(stop_words)))
    if prefix:
        t = t.withColumn("term", F.substring("term", 1, prefix))
    return t.select("term", "doc", "col", "pos")


def term(index: DataFrame, word: str, column: str | None = None) -> DataFrame:
    t = index.filter(F.col("term") == word.lower())
    return (t.filter(F.col("col") == column) if column else t).select("doc").distinct()


def prefix(index: DataFrame, start: str, column: str | None = None) -> DataFrame:
    t = index.filter(F.col("term").startswith(start.lower()))
    return (t.filter(F.col("col") == column) if column else t).select("doc").distinct()


def phrase(index: DataFrame, words: list[str], column: str | None = None) -> DataFrame:
    """Consecutive positions: each word's positions are moved back to the phrase's start, and a start must have them all.
    One aggregation instead of a self join per word."""
    t = index.filter(F.col("col") == column) if column else index
    at = [i for w in dict.fromkeys(x.lower() for x in words) for i in [w]]
    hit = t.filter(F.col("term").isin(*at))
    offsets = F.filter(F.array(*[F.when(F.col("term") == w.lower(), F.lit(i)) for i, w in enumerate(words)]), lambda x: x.isNotNull())
    starts = hit.select("doc", "col", F.col("pos"), F.explode(offsets).alias("i")).select("doc", "col", (F.col("pos") - F.col("i")).alias("start"), "i")
    return starts.groupBy("doc", "col", "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(words)).select("doc").distinct()


_QUERY = re.compile(r'"([^"]*)"|\(|\)|[^\s()"]+')


def match(index: DataFrame, query: str) -> DataFrame:
    """MATCH grammar: terms, "phrases", prefix*, col:term, AND (also implied), OR, NOT, parentheses. Result: doc."""
    parts = [(m[0], m[1]) for m in _QUERY.finditer(query)]
    at = 0

    def peek() -> str | None:
        return parts[at][0] if at < len(parts) else None

    def primary() -> DataFrame:
        nonlocal at
        whole, quoted = parts[at]
        at += 1
        if whole == "(":
            out = either()
            at += 1
            return out
        if whole.startswith('"'):
            return phrase(index, re.findall("[a-z0-9]+", quoted.lower()))
        column, _, word = whole.rpartition(":")
        if word.endswith("*"):
            return prefix(index, word[:-1], column or None)
        return term(index, word, column or None)

    def both() -> DataFrame:
        nonlocal at
        out = primary()
        while (p := peek()) is not None and p not in (")", "OR"):
            if p == "NOT":
                at += 1
                out = out.join(primary(), "doc", "left_anti")
            else:
                at += p == "AND"
                out = out.join(primary(), "doc", "left_semi")
        return out

    def either() -> DataFrame:
        nonlocal at
        out = both()
        while peek() == "OR":
            at += 1
            out = out.unionAll(both()).distinct()
        return out

    return either()


def _frequencies(index: DataFrame, words: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    lengths = index.groupBy("doc").agg(F.count("*").alias("len"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = index.filter(F.col("term").isin(*[w.lower() for w in words])).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return lengths, stats, tf


def bm25(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc, score): k1 = 1.2, b = 0.75, idf = ln((N - df + 0.5) / (df + 0.5) + 1). The two one-row tables are broadcast by Catalyst."""
    lengths, stats, tf = _frequencies(index, words)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # df has a row per query word and stats one row: both bounded
    return tf.join(F.broadcast(df), "term").join(lengths, "doc").crossJoin(F.broadcast(stats)).groupBy("doc").agg(F.sum(idf * part).alias("score"))


def tf_idf(index: DataFrame, words: list[str]) -> DataFrame:
    lengths, stats, tf = _frequencies(index, words)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(F.broadcast(df), "term").join(lengths, "doc").crossJoin(F.broadcast(stats)).groupBy("doc").agg(F.sum(F.col("tf") / F.col("len") * F.log(F.col("n_docs") / F.col("df"))).alias("score"))


def simple_rank(index: DataFrame, words: list[str]) -> DataFrame:
    """Occurrences of the words."""
    return index.filter(F.col("term").isin(*[w.lower() for w in words])).groupBy("doc").agg(F.count("*").alias("score"))


def insert_docs(index: DataFrame, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return index.unionByName(tokens(df, key, columns))


def delete_docs(index: DataFrame, docs: DataFrame) -> DataFrame:
    return index.join(docs.select(F.col(docs.columns[0]).alias("doc")), "doc", "left_anti").select("term", "doc", "col", "pos")


def matches(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds, without an index."""
    held = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.size(F.array_intersect(F.array(*[F.lit(w.lower()) for w in words]), held))
