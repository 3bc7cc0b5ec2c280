"""The ten operators against brute-force versions, round trips and held-out accuracy, and their edge cases."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import byte_bpe, chat_format, common, fingerprints, html_extract, jaccard_join, packing, quality_rules, secret_scan, toxicity, warc
from brindle.llm.queries import queries

P = pytest.importorskip("public_tokenizers")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
FOLDER = "/root/testdata/sf0.001"
SCHEMA = "text string, doc_id long, lang string, node string, digest string, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

ODD = [(None, 1), ("", 2), (" \n\t ", 3), ("one", 4), ("one", 4), ("two  words", None), ("a b c d e f g", 6), ("A b C d e f g", 7), ("é日本 <|endoftext|> \U0001f389 \x1c\x85 x", 8), ("long " * 30_000, 9), ("x" * 9000, 10), ("\n\n a \n \n b  ", 11)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(t, i, None, "n", "d", 1) for t, i in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- 1


@pytest.mark.parametrize("source", ["odd", "docs", "nothing"])
def test_packing(source, request, spark):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(source)
    tok = Tokenizer.from_file(JSON)
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in pairs(df))
    out = packing.pack(df, JSON).toPandas()
    if source == "nothing":
        assert len(out) == 0
        return
    whole = collections.Counter()
    held = collections.defaultdict(list)
    for r in out.itertuples():
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        held[None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens].append((r.start, r.ids))
    for (i, n), parts in held.items():
        times = sum(len(b) for _, b in parts) // 4 // n
        joined = b"".join(b for _, b in sorted(parts)) if times == 1 else b"".join(b for s, b in sorted(parts)[::times])
        whole[i, tuple(np.frombuffer(joined, "<u4").tolist())] += times
    assert whole == want
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= 1024 and all(n & (n - 1) == 0 for n in sizes)
    s = out.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    assert out.groupby("step_group").length.sum().max() <= packing.STEP_TOKENS and out.groupby("step_group").tier.nunique().max() == 1


def test_step_groups_are_evenly_full():
    r = random.Random(4)
    packer = packing.Packer(3, packing.TIERS, 8192, False)
    for i in range(900):
        packer.add(i, b"\1\0\0\0" * int(r.lognormvariate(5, 1.2) + 1))
    packer.finish()
    filled, tiers = collections.Counter(), collections.defaultdict(set)
    for _, _, length, _, _, _, _, tier, step in packer.flush():
        filled[step] += length
        tiers[tier].add(step)
    for steps in tiers.values():
        assert all(filled[s] <= 8192 for s in steps)
        assert len(steps) == 1 or min(filled[s] for s in steps) >= 4096 - 1024
    assert max(map(len, tiers.values())) > 2


def test_chunks_are_the_librarys_ids():
    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(JSON), random.Random(8)
    pieces = ["a", "The", "x" * 300, "é日", "\n", "\t", "don't", "12345", "\u3000", "<|endoftext|>", "!?", "\xa0z", "e\u0301", "", "\U0001f389b", "q" * 8, "q" * 9]
    texts = [r.choice([" ", " ", " ", "  ", "\n", " \n"]).join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    encode = packing.TokenizerChunks(JSON)
    for at in range(0, 3000, 250):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts[at : at + 250])] == [tok.encode(t, add_special_tokens=False).ids for t in texts[at : at + 250]]


# --- 2


def test_toxicity(spark):
    r = random.Random(5)
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(1500):
        words = [r.choice("the of and to in red blue tree house walk run".split()) + r.choice(["", "s", "ed"]) for _ in range(r.randint(10, 60))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((" ".join(words), i))
        if i % 2 == 0 or toxic and i % 4:
            labels.append((i, int(toxic), "x"))
    docs = spark.createDataFrame(rows, "text string, doc_id long")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.train(docs, known)
    got = toxicity.score(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).toPandas()
    held = got[got.h]
    assert set(held.doc_id) == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert ((held.predicted == 1) == (held.doc_id % 9 == 0)).mean() > 0.98
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    # labels of the held-out fold change nothing
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert again.vocabulary == model.vocabulary and np.allclose(again.weights, model.weights)
    kept = {x["doc_id"] for x in toxicity.keep(docs, model).collect()}
    assert kept == set(got[got.predicted == 0].doc_id)


def test_toxicity_edges(odd, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.score(nothing, toxicity.train(nothing, none)).count() == 0
    some = spark.createDataFrame([(4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, some)).count() == len(ODD)
    assert toxicity.keep(odd, model).columns == odd.columns


def test_nnpu_risk_is_not_negative():
    r = np.random.default_rng(1)
    p, u = r.normal(2, 1, (200, 3)).astype(np.float32), r.normal(0, 1, (2000, 3)).astype(np.float32)
    u[:200] += 2
    w, b = toxicity.fit_nnpu(p, u, 0.1)
    assert ((p @ w + b) > 0).mean() > 0.6 and ((u[200:] @ w + b) > 0).mean() < 0.1


# --- 3


def brute_components(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            least[find(k)] = min([x for x in (least.get(find(k)), i) if x is not None], default=None)
    return collections.Counter((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def near_copies(seed=2):
    r = random.Random(seed)
    rows = []
    for group, size in enumerate((60, 3, 1, 1, 25)):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(30, 200))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 99)}"
            rows.append(" ".join(w) + (" shared passage " + " ".join(f"p{k}" for k in range(40)) if r.random() < 0.3 else ""))
    rows += ["a b c", "A b  c", "b c", "", None, "x", "x", " ".join(f"n{k}" for k in range(12)), " ".join(f"n{k}" for k in range(11))]
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width,num,den,block", [(3, 9, 10, None), (5, 4, 5, None), (3, 9, 10, 1500), (3, 1, 2, None)])
def test_jaccard_join(spark, monkeypatch, width, num, den, block):
    if block:  # clusters larger than a block are solved by pairs of blocks
        monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", block)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(df, width, num, den).collect())
    assert got == brute_components(rows, width, num, den)


def test_jaccard_join_edges(odd, nothing):
    got = jaccard_join.link(odd, 3, 9, 10).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components([(i, t) for t, i in ODD], 3, 9, 10)
    assert jaccard_join.link(nothing).count() == 0 and jaccard_join.keep_one(nothing).columns == nothing.columns
    kept = jaccard_join.keep_one(odd, 3, 9, 10)
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [i for i, _ in left] == [0, 1, 2, 3, 4, 6, 8, 9, 10, 11]


def test_keep_one_judges_rows_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, c), (None, d), (None, d), (3, a), (5, a + " end"), (5, b), (7, ""), (7, ""), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(df).collect())
    assert kept == collections.Counter([(None, c), (None, d), (3, a), (5, b), (7, ""), (7, ""), (None, None), (None, " ")])


def test_fetched_texts_are_the_wanted_ones(spark):
    """Whether Spark may broadcast the wanted rows or not; repeated rows, null ids and copies under other ids."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 500 if i % 7 else None, f"text {i % 300}") for i in range(2000)], "doc_id long, text string")
    wanted = df.filter("doc_id is null or doc_id < 40").distinct().select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("id_mark"), F.lit(1).alias("root"))
    want = collections.Counter((r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is None or r["doc_id"] < 40)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = collections.Counter((r["doc_id"], r["text"]) for r in jaccard_join._fetched(df, wanted).collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert got == want
    assert jaccard_join._fetched(df, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [400_000, 3])
def test_components(spark, monkeypatch, batch):
    """A long path, a hub, repeated and reversed edges and loops; once with a single last batch, once by rounds."""
    from brindle.llm import components

    monkeypatch.setattr(components, "BATCH", batch)
    edges = [(k, k + 1) for k in range(100, 140)] + [(k, 500) for k in range(501, 560)] + [(7, 3), (3, 7), (7, 3), (9, 9), (560, 559)]
    random.Random(4).shuffle(edges)
    want = {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(500, 561), 500), 3: 3, 7: 3}
    got = [(r["node"], r["root"]) for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_solver_answers_are_exact():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 120, dtype=np.uint64)
    sets = []
    for _ in range(90):
        s = base.copy()
        s[r.integers(0, 120, r.integers(0, 14))] = r.integers(0, 1 << 60)
        sets.append(np.unique(s))
    found = jaccard_join.Solver(sets, None, 9, 10).roots()
    rows = [(i, " ".join(map(str, s.tolist()))) for i, s in enumerate(sets)]
    want = {i: c for i, _, c in brute_components(rows, 1, 9, 10)}
    for a in range(90):
        for b in range(90):
            assert (found[a] == found[b]) == (want[a] == want[b])


# --- 4


def test_html_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body><header>Site name</header>
      <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, and here is a long text on it.</div>
      <article><h1>Title &amp; more</h1><p>First&nbsp;para\n with <a href=x>a link</a>.<p>Second <b>bold</b> one<!-- no --><div class="ad">Buy this thing now</div>
      <p>x</p><form><p>Your mail</p><input></form></article><aside>Related things that people like to read</aside>
      <section class="comments"><p>I liked this article very much, thanks for it.</p></section><footer>&copy; Site</footer>"""
    assert html_extract.main_text(page) == "Title & more\n\nFirst para with a link.\n\nSecond bold one\n\nx"
    plain = "<body><div id=menu><a>a</a> <a>b</a></div><p>" + "word " * 40 + "</p><p>short end</p><p>" + "more " * 30 + "</p><div><a>next page</a></div><div>(c) x</div>"
    assert html_extract.main_text(plain) == "\n\n".join(["word " * 39 + "word", "short end", "more " * 29 + "more"])
    for broken in ("", "<", "<p", "<article><p>a", "</p></div>", "<script>never ends", "&#x41;&bogus;", "<p>" * 3000):
        html_extract.main_text(broken)


def test_html_keeps_long_paragraphs_before_short_blocks():
    long = "word " * 107 + "word"
    for before in (long, "one two", "<a>Home</a>"):
        for after in ("", "<h2>Next</h2>", "<p>A short one.</p>", f"<p>{long}</p>"):
            for n in (14, 17, 40, 150):
                text = " ".join(["para"] * n)
                assert text in html_extract.main_text(f"<nav>menu</nav><article><p>{before}</p><p>{text}</p>{after}</article><footer>(c) x</footer>")
                if n > 20:
                    assert text in html_extract.main_text(f"<body><p>{before}</p><p>{text}</p>{after}</body>")


def test_html_keeps_every_paragraph_of_the_articles():
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    n = 0
    for page in pq.read_table(f"{folder}/pages.parquet").column("html").to_pylist():
        text = html_extract.main_text(page or "")
        for b in html_extract.blocks(page or ""):
            if b.in_main and not b.apart:
                n += 1
                assert b.text in text
    assert n > 20_000


def test_html_table(spark, nothing):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<article><p>hello</p></article>"), (1, "u", "<article><p>hello</p></article>")], "html string, page_id long, url string".replace("html string, page_id long, url string", "page_id long, url string, html string"))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()) == [(0, "", 0), (1, "hello", 5), (1, "hello", 5)]
    assert html_extract.extract(df.limit(0)).count() == 0


# --- 5


def test_bpe_is_tiktoken():
    import tiktoken

    e = byte_bpe.Encoder(RANKS, P.PATTERN)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = [t or "" for t, _ in ODD] + ["".join(r.choice(list("ab \n\t'sé1., \x1c\x85")) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(t) and e.decode(ids) == t.encode()
    for w in ("banana", "ab" * 300, "日本語" * 90):
        assert byte_bpe.merge(w.encode(), ranks) == byte_bpe._fold_long(w.encode(), ranks)


def test_bpe_sql_fold(spark):
    """The higher-order-function form gives the same ids for the words of a dictionary table."""
    words = ["the", "banana", "é", "unbelievable", "", " x"]
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    got = [r[0] for r in df.select(byte_bpe.fold_merges_sql(F.col("w"), byte_bpe.rank_literal(RANKS))).collect()]
    ranks = byte_bpe.load_ranks(RANKS)
    assert got == [byte_bpe.merge(w.encode(), ranks) if w else [] for w in words]


def test_bpe_table(odd, nothing):
    out = {(r["doc_id"], r["decoded_sha256"]) for r in byte_bpe.round_trip(odd, RANKS, P.PATTERN).collect()}
    assert out == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for t, i in ODD}
    assert byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == len(ODD)
    assert byte_bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


# --- 6


def brute_quality(t):
    w = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        dup += bool(WORD.search(x)) and x in seen
        seen.add(x)
    wins = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_quality(docs, odd, nothing):
    for _, t in pairs(docs) + pairs(odd):
        assert quality_rules.base_counts(t or "") == brute_quality(t or "")
    out = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(not r["kept"] for r in out.values() if r["base_failed"])
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == {i for i, r in out.items() if r["kept"]}
    assert quality_rules.keep(docs).columns == docs.columns and quality_rules.judge(nothing).count() == 0
    assert quality_rules.judge(odd).count() == len(ODD)


def test_quality_bands():
    import zstandard

    z = zstandard.ZstdCompressor(level=3).compress
    r = random.Random(4)
    prose = " ".join(r.choice("the river was long and the people who lived by it knew every stone of its bank though none had ever seen where began".split()) + r.choice(["", "s", "ing", "ed", ",", "."]) + str(r.randint(0, 9)) for _ in range(500))
    assert quality_rules.verdict(b"same words again " * 300, z)[0] is False
    assert quality_rules.verdict(base64.b64encode(r.randbytes(6000)), z)[0] is False
    assert 0.3 < quality_rules.verdict(prose.encode(), z)[1] < 0.6


def test_quality_keeps_very_long_clean_texts():
    import pyarrow.parquet as pq
    import zstandard

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    z = zstandard.ZstdCompressor(level=3).compress
    clean, seen = collections.defaultdict(list), set()
    for r in pq.read_table(f"{folder}/documents.parquet", columns=["text", "lang"]).to_pylist():
        raw = (r["text"] or "").encode()
        if 1500 <= len(raw) < 40_000 and raw[:200] not in seen and quality_rules.verdict(raw, z)[0]:
            seen.add(raw[:200])
            clean[r["lang"]].append(raw)
    tried = collections.Counter()
    for lang, parts in clean.items():
        whole = b"\n".join(parts)
        for n in (70_000, 140_000, 300_000, 500_000, 524_288, 1_000_000, 1_500_000, 2_500_000, 5_000_000):
            if len(whole) >= n:
                tried[n] += 1
                assert quality_rules.verdict(whole[:n], z)[0], (lang, n)
    assert tried[1_500_000] >= 4 and tried[5_000_000] >= 1
    once = b"\n".join(clean["en"])
    for n in (250_000, 600_000):
        assert not quality_rules.verdict(once[:n] * 2, z)[0]


# --- 7


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n a<\\|b <\\\\| $1 \\", "x<", "|>\n<|user|>", "", None, "<|" * 50]
    rows = [(k % 3, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)] + [(5, 0, "a<|b|>\n", "t"), (5, 0, "a<|b|>\n", "t"), (6, None, None, None), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.digest(df).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == k))
        said = "".join(f"{role}\n{x}\n" for _, role, x in mine)
        loss = "".join(x for _, role, x in mine if role == "assistant")
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(df.limit(0)).count() == 0


def brute_fold(events):
    turns = {}
    for _, kind, role, text, turn in sorted((s, k, r, x, t) for s, t, k, r, x in events):
        if kind == "regenerate":
            turns = {t: v for t, v in turns.items() if t <= turn}
            turns[turn] = [turns.get(turn, [role])[0] or role, ""]
        elif kind == "edit":
            turns[turn] = [turns.get(turn, [role])[0] or role, text]
        else:
            old = turns.get(turn, [role, ""])
            turns[turn] = [old[0] or role, old[1] + text]
    return [(t, *turns[t]) for t in sorted(turns)]


def test_chat_events(spark):
    r = random.Random(8)
    logs = {c: [(s, r.randint(1, 4), r.choice(["delta", "delta", "delta", "edit", "regenerate"]), r.choice(["user", "assistant"]), r.choice("abc")) for s in range(r.randint(0, 14))] for c in range(40)}
    df = spark.createDataFrame([(c, *e) for c, es in logs.items() for e in es], "conv_id long, seq long, turn long, kind string, role string, text string").repartition(5)
    got = {x["conv_id"]: [(m["turn"], m["text"]) for m in x["messages"]] for x in chat_format.reconstruct(df).collect()}
    assert got == {c: [(t, x) for t, _, x in brute_fold(es)] for c, es in logs.items() if es}
    plan = chat_format.digest(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 8


def test_warc(spark):
    rows = [(1, "http://a/1", "a" * 200), (2, "u", "a" * 200), (3, "u", "b"), (4, "u", "b"), (5, None, None), (6, "line\nbreak", "é" * 60), (6, "u", "é" * 60), (7, "u", "é" * 60), (None, "u", "a" * 200), (8, "u", "WARC/1.1\r\n\r\n" * 30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read(warc.write(df)).collect())
    assert got == [(0, 200, "revisit", 1), (1, 200, "response", 0), (2, 200, "revisit", 1), (3, 1, "response", 0), (4, 1, "response", 0), (5, 0, "response", 0), (6, 120, "response", 0), (6, 120, "response", 0), (7, 120, "revisit", 6), (8, 360, "response", 0)]
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_file_begins_with_its_dictionary(tmp_path):
    import struct

    import zstandard

    records = [warc.record(i, f"http://x/{i}", f"<p>page {i} of many</p>".encode() * 20, None, False) for i in range(200)]
    d = warc.build_dictionary(records)
    with open(tmp_path / "a", "wb") as f:
        assert warc.write_archive(f, d, iter(records)) == 200
    raw = (tmp_path / "a").read_bytes()
    assert struct.unpack("<II", raw[:8]) == (0x184D2A5D, len(d)) and raw[8 : 8 + len(d)] == d
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)).decompressobj().decompress(raw[8 + len(d) :])
    assert first == records[0]
    with open(tmp_path / "a", "rb") as f:
        assert [h["WARC-Record-ID"] for h, _ in warc.read_archive(f)] == [f"<urn:page:{i}>" for i in range(200)]


# --- 9


def brute_spans(t):
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    b = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(a + b + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(docs, odd, nothing):
    texts = [t or "" for _, t in pairs(docs) + pairs(odd)] + ['é PassWord = "abcd1234" x', "token: short", "AKIA" + "A" * 12 + "b", "f" * 31, "g" + "0" * 40 + "AKIA1", "api_key='x' token=AKIA" + "Z" * 20 + " " + "ab" * 20, "API-KEY=12345678 secret:=abcdefgh"]
    for t in texts:
        assert secret_scan.base_spans(t) == brute_spans(t)
    r = random.Random(77)
    found = total = 0
    for _, parts in secret_scan.FORMATS:
        for _ in range(30):
            w = "".join(p if isinstance(p, str) else "".join(r.choice(p[0]) for _ in range(p[1])) for p in parts)
            total += 1
            found += bool(secret_scan.grammar_spans(f"see {w} there", []))
    assert found / total >= 0.9
    for clean in ("www.example.com/page/12345", "2024-01-02-03-04-05-06", "user_name_with_12_parts", "A" * 20 + "1", "1234567890" * 3):
        assert secret_scan.grammar_spans(clean, []) == []
    assert secret_scan.scan(nothing).count() == 0 and secret_scan.scan(odd).count() == len(ODD)


def test_secrets_in_urls_paths_and_assignments():
    r = random.Random(78)
    found = total = 0
    for name, words in secret_scan.labelled_credentials(20).items():
        for w in words:
            if secret_scan.score(w)[0] < secret_scan.THRESHOLD or not any(c.isdigit() for c in w):
                continue
            for before, after in (("https://maps.example/js?v=2&key=", ""), ("GH=", ""), ("export CI=", ""), ("host/path/", ""), ("x", ""), ("a1.b+", ""), ("", "/x"), ("k=", "="), ("AKIA" + "Z" * 16 + "/", "")):
                text = f"see {before}{w}{after} there"
                spans = secret_scan.grammar_spans(text, secret_scan.base_spans(text))
                at = 4 + len(before)
                total += 1
                found += any(s == at and e == at + len(w) for s, _, e in spans)
    assert total > 1000 and found >= 0.99 * total
    a, b = "ghp_" + "".join(r.choice(secret_scan._ALNUM) for _ in range(36)), "gho_" + "".join(r.choice(secret_scan._ALNUM) for _ in range(36))
    assert secret_scan.grammar_spans(a + b, []) == [(0, 3, 40), (40, 3, 80)]
    text = f"x={'0f' * 20}/{a}/token=abcdefgh1"
    assert secret_scan.grammar_spans(text, secret_scan.base_spans(text)) == [(43, 3, 83)]


def test_redact(spark):
    df = spark.createDataFrame([(1, 'a token = "abcdef123456" b', 5), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secret_scan.redact(df).orderBy("doc_id").collect()] == [(1, 'a [SECRET]" b', 13), (2, None, 0), (3, "clean", 5)]


# --- 10


def test_fingerprints(docs, odd, nothing):
    for df in (docs, odd):
        rows = sorted(pairs(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        texts = [t or "" for _, t in rows]
        want = collections.Counter()
        for k, (i, _) in enumerate(rows):
            e = fingerprints.edited(texts[k], texts[(k + 1) % len(rows)])
            want[i, len(texts[k]), hashlib.sha256(e.encode()).hexdigest(), fingerprints.packed(texts[k]), fingerprints.packed(e)] += 1
        for ranges in (None, 3):
            got = fingerprints.with_edited(df, ranges).collect()
            assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == want
            assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.with_edited(nothing).count() == 0


def test_likeness_estimates_jaccard():
    r = random.Random(6)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(15):
            n = 600
            same = [str(r.random()) for _ in range(int(n * share))]
            a, b = (" ".join(same + [str(r.random()) for _ in range(n - len(same))]) for _ in range(2))
            x, y = ({*fingerprints.shingle_hashes(t).tolist()} for t in (a, b))
            errors.append(fingerprints.likeness(fingerprints.packed(a), fingerprints.packed(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    few = fingerprints.one_permutation(np.array([1 << 60, 5], np.uint64))
    assert len(set(few.tolist())) == 2


# --- all


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs_over_the_whole_table(name, spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    out = queries()[name](spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/{'pages' if name.startswith(('op4_', 'op8_')) else 'documents'}.parquet").count()
    rows = out.count()
    assert rows == n if name[:4] not in ("op1_", "op7_", "pipe") else rows > 0


def test_cut_goes_to_the_shared_folder(spark):
    df = common.cut(spark.range(3), "t")
    assert df.count() == 3 and all(common.shared_dir(spark).removeprefix("file://") in f for f in df.inputFiles())


def test_a_worker_keeps_the_state_of_one_operator(monkeypatch):
    from brindle.llm import common

    monkeypatch.setattr(common, "_warm", {})
    first = common.warm("a", 1, lambda: [1])
    assert common.warm("a", 1, lambda: [2]) is first and common.warm("a", 2, lambda: [3]) == [3]
    common.release("a")
    assert common.warm("a", 2, lambda: [4]) == [3]
    common.release("b")
    assert common.warm("a", 2, lambda: [5]) == [5]
    common.release(None)
    assert not common._warm
