"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colonnade.llm import decontam, langid, maxent, minhash, pieces, quotes, sharding, simhash, tokenfiles, toxicity
from colonnade.llm.common import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, f0 int, digest string, key string, _bucket int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977} the" for i in range(40_000))
ODD = [(1, None, None), (2, "", "en"), (3, " \n\t ", None), (4, "The cat. Sat on THE mat!", "en"), (5, "The cat. Sat on THE mat!", "en"), (6, "É été 漢字 ᴀ 😀 ▁x", "fr"), (7, LONG, "en"), (7, LONG, "en"), (9, ">>> ... 123", "de"), (10, "one", "en")]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(d, t, lang, None, None, 1, "x", "k", 3) for d, t, lang in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(text, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(3, 1), (1, 2), (7, 7), (100, 5), (5, 200), (200, 100)]
    nodes = {x for e in edges for x in e} - {7}
    assert dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()) == components_of(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def sql(con, query, df):
    relation = con.sql(query)
    order = sorted(relation.columns)
    assert sorted(df.columns) == order
    assert rows(df.select(*order)) == sorted(relation.select(*order).fetchall(), key=repr)


def test_decontamination_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql(con, decontam.OP1_SQL, decontam.op1_decontamination(spark, DATA))


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_decontamination_brute_force(spark, none, by_shuffle, monkeypatch):
    if by_shuffle:
        monkeypatch.setattr(decontam, "fits", lambda *_: False)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 12, 40])), None) for i in range(40)] + [(50, None, None), (51, "Q1 q1 É q1", None), (51, "Q1 q1 É q1", None)]
    items = [(k, text(10)) for k in range(6)] + [(7, "b,C"), (8, "q1 Q1"), (8, "a b c d a b c d a"), (9, ""), (10, None), (11, text(14))]
    pattern = decontam.BETWEEN.replace("[", "[^", 1)
    windows = {}
    for k, t in items:
        w = words(t, pattern.replace("\\x41-\\x5A", ""))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    want = Counter()
    for d, t, _ in docs:
        w, hit, ids = words(t, pattern), set(), set()
        for win, ks in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= ks
        want[d, len(w), len(hit), tuple(sorted(ids))] += 1
    found = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    got = Counter()
    for r in found.collect():
        got[r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))] += r.copies
    assert got == want
    assert decontam.contamination(none, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    clean = decontam.decontaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert clean.columns == none.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    assert decontam.decontaminated(frame(spark, docs), spark.createDataFrame([], "item_id bigint, text string")).count() == len(docs)


def test_quotes_match_sql(spark):
    con = duckdb.connect()
    messages = [(1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> hello there\nFine"), (1, 2, "u", "> Fine!\n>> Hello there.\n\nOK then"), (1, 3, "x", ">> how ARE you\nOn Mon X wrote:\nlate"), (1, 3, "x", ">> how ARE you\nOn Mon X wrote:\nlate"), (1, 5000, "y", "what"), (2, 7, "u", None), (2, 9, "u", ""), (None, 1, "u", "a"), (3, None, "u", "b")] + [(4, t, "u", f"line {t}\n> line {t // 3}") for t in range(0, 4000, 7)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame(messages, schema)
    con.execute("CREATE TABLE conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", messages)
    sql(con, quotes.OP2_SQL, quotes.threaded(df.selectExpr("*", "1 AS key", "2 AS up")))
    assert quotes.threaded(spark.createDataFrame([], schema)).count() == 0
    r = {x.turn: x for x in quotes.threaded(df.where("conv_id = 1")).collect()}
    assert (r[2].parent_turn, r[2].depth, r[2].quoted, r[2].text) == (1, 2, True, "OK then") and r[3].parent_turn == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n).astype(np.uint16) for n in (0, 1, 5, 300)] + [np.zeros(500, np.uint16), np.tile(np.arange(7, dtype=np.uint16), 80), np.full(200, 65535, np.uint16)]
    codes = tokenfiles.encode_blocks(blocks)
    assert all(map(np.array_equal, blocks, tokenfiles.decode_blocks(codes, list(map(len, blocks)))))
    assert len(codes[4]) < 60
    frames = [rng.zipf(1.3, n).clip(0, 65535).astype(np.uint16) for n in (0, 1, 4096, 9000)]
    payloads = tokenfiles.packed(frames)
    assert all(map(np.array_equal, frames, tokenfiles.unpacked(payloads)))
    damaged = bytearray(payloads[3])
    damaged[-2000] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.unpacked([bytes(damaged)])


def test_range_coder_beats_deflate_on_the_same_blocks(docs):
    import public_tokenizers

    memory = tokenfiles.Tokens(public_tokenizers.path(tokenfiles.FILE))
    ids = np.concatenate(memory.encode([r.text or "" for r in docs.orderBy("doc_id").collect()]))
    blocks = [ids[i : i + tokenfiles.BLOCK] for i in range(0, len(ids), tokenfiles.BLOCK)]
    codes = tokenfiles.encode_blocks(blocks)
    assert all(map(np.array_equal, blocks, tokenfiles.decode_blocks(codes, list(map(len, blocks)))))
    assert 2 * sum(map(len, codes)) < 0.9 * sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks)


def test_token_files(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfiles.FILE)
    t = Tokenizer.from_file(path)
    whole = lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]
    memory, plain = tokenfiles.Tokens(path), tokenfiles.Tokens(path, plain=True)
    assert 50256 in whole("x <|endoftext|> y") and 50256 not in plain.encode(["x <|endoftext|> y"])[0]
    for s in ("a  b", "a   b \n c\n\n d", "x <|endoftext|> y", "  lead", "tab\t x", "a\x1c b", "it's 's  's 12 a1", "é ñ　漢 字", ""):
        assert memory.encode([s])[0].tolist() == whole(s)
    want, start = [], 0
    for d, text, _ in sorted(ODD, key=lambda r: (r[0], r[1] or "")):
        ids = whole(text)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(tokenfiles.read_back(tokenfiles.framed(odd, path, 3).cache())) == sorted(want, key=repr)
    assert tokenfiles.read_back(tokenfiles.framed(none, path, 3)).count() == 0


def test_differencing():
    rng = random.Random(1)
    for n, batch in ((0, 10), (1, 10), (500, 10_000), (500, 60)):
        sizes = [rng.randint(1, 5000) for _ in range(n)]
        out = sharding.differencing(sizes, 7, batch)
        assert len(out) == n and all(0 <= s < 7 for s in out)
        if n > 7:
            sums = np.bincount(out, weights=sizes, minlength=7)
            assert sums.max() - sums.min() <= 60


def test_sharding(spark, odd, none, docs):
    for df in (odd, docs):
        out = sharding.sharded(df).collect()
        assert len(out) == df.count()
        by, seen = {}, {}
        for r in out:
            by.setdefault(r.shard, []).append(r.slot)
            assert seen.setdefault((r.text_crc32, r.size), r.shard) == r.shard
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sum(r["size"] for r in out) == sum(len((r.text or "").encode()) + 8 for r in docs.collect())
    assert sharding.sharded(none).count() == 0


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.selectExpr("*", "1 AS text"))
    scored = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(r.toxic, scored[r.doc_id].predicted) for r in labels.collect() if scored[r.doc_id].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in toxicity.scored(odd, model).collect())
    assert toxicity.scored(none, model).count() == 0
    nothing = toxicity.fit(none, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    assert toxicity.scored(odd, nothing).count() == len(ODD) and toxicity.cleaned(odd, labels.limit(0)).columns == odd.columns


def test_offending_sentences_are_found(spark):
    rng = random.Random(3)
    text = lambda bad: ". ".join(" ".join(rng.choice(["sun", "sea", "hill", "road", "bird"]) for _ in range(6)) + (" vile" if bad and k == 2 else "") for k in range(5))
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(600)], "doc_id bigint, text string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS toxic"))
    assert {(r.doc_id, r.sentence) for r in toxicity.offending(docs, model).collect()} == {(i, 2) for i in range(0, 600, 3)}


def simhash_of(text):
    w = words(text)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_brute_force(spark, docs, odd, none, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    for df in (docs, odd):
        prints = {}
        for r in df.collect():
            prints.setdefault(r.doc_id, simhash_of(r.text))
        ids = list(prints)
        want = components_of(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2])
        got = simhash.linked(df).collect()
        assert len(got) == df.count()
        assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)
    assert simhash.linked(none).count() == 0


def test_simhash_links(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for p in list(prints)[:20]:
        for _ in range(8):
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = components_of(signed, pairs)
    df = spark.createDataFrame([(p,) for p in signed], "f bigint")
    assert components_of(signed, [tuple(r) for r in simhash.fingerprint_links(df).collect()]) == want


def test_near_duplicates(spark, odd, none):
    rng = random.Random(4)
    base = [" ".join(f"v{rng.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    edit = lambda t, n: " ".join("new" if i < n else w for i, w in enumerate(t.split()))
    docs = [(i, t, None) for i, t in enumerate(base)] + [(100 + i, edit(t, 2), None) for i, t in enumerate(base)] + [(200, base[0], None), (201, base[0], None), (201, base[0], None)]
    kept = simhash.deduplicated(frame(spark, docs))
    assert kept.columns == none.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(30)) <= set(ids) and len(ids) == len(set(ids)) and len(ids) <= 31 and not {200, 201} & set(ids)
    assert {r.doc_id for r in simhash.deduplicated(odd).collect()} == {1, 4, 6, 7, 9, 10}
    assert simhash.deduplicated(none).count() == 0


def kept_ids(spark, texts):
    return sorted(r.doc_id for r in simhash.deduplicated(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect())


def test_near_duplicates_with_a_repeated_line(spark):
    """A line that one of two texts repeats often adds hardly a distinct shingle."""
    rng = random.Random(6)
    texts = []
    for _ in range(20):
        body, line = (" ".join(f"v{rng.randrange(5000)}" for _ in range(n)) for n in (300, 12))
        texts += [f"{body} {line}", f"{body} " + " ".join([line] * 60)]
    assert kept_ids(spark, texts) == list(range(0, 40, 2))


def brute_kept(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    found = components_of(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    return sorted(set(found.values()))


def test_near_duplicates_with_edited_blocks(spark):
    """Blocks appended, cut and replaced, of likeness about 0.8, against brute force."""
    rng = random.Random(7)
    some = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for k in range(120):
        n = (60, 100, 400)[k % 3]
        base, block = some(n), int(n * rng.uniform(0.1, 0.26))
        edited = [base + some(block), base[: n - block], base[: n // 3] + some(block // 2) + base[n // 3 + block // 2 :]][k % 4 % 3]
        texts += [" ".join(base), " ".join(edited)]
    want = brute_kept(texts)
    assert 130 < len(want) < 200
    assert kept_ids(spark, texts) == want


def test_near_duplicates_by_fingerprints(spark, monkeypatch):
    """Without the first shingles, what linked fingerprints of distinct shingles give and whole texts confirm is found."""
    real = simhash.prefixes
    monkeypatch.setattr(simhash, "prefixes", lambda *a: real(*a).withColumn("keys", F.array().cast("array<bigint>")))
    rng = random.Random(10)
    texts = []
    for _ in range(30):
        w = [f"v{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(w), " ".join([*w[:-1], "end"]), " ".join([*w[:300], "new", *w[301:], *w])]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    prints = [simhash.fingerprint(h) & (2**64 - 1) for h in sets]
    met = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    alike = [(i, j) for i, j in met if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    want = sorted(set(components_of(range(len(texts)), alike).values()))
    assert len(want) < 75
    assert kept_ids(spark, texts) == want


@pytest.mark.parametrize("held", [500_000, 0])
def test_shingle_sets(spark, held, monkeypatch):
    """The rows of nodes are found by a small table and by a shuffle alike; null ids and texts have a place."""
    monkeypatch.setattr(simhash, "HELD", held, raising=False)
    docs = frame(spark, [(1, "a b c", None), (1, "d e f", None), (None, "a b c", None), (2, None, None), (3, "left out", None)])
    nodes = docs.where("doc_id IS NULL OR doc_id < 3").select(F.monotonically_increasing_id().alias("node"), "doc_id", simhash.text_md5().alias("text_md5"), "text").localCheckpoint()
    found = {r.node: sorted(r.shingles) for r in simhash.shingle_sets(docs, nodes.drop("text"), 5).collect()}
    assert found == {r.node: sorted(np.unique(simhash.shingle_hashes(r.text, 5)).view(np.int64).tolist()) for r in nodes.collect()}
    plan = simhash.shingle_sets(docs, nodes.drop("text"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan  # a broadcast table of nodes weighs on the driver
    assert simhash.shingle_sets(docs, nodes.drop("text").limit(0), 5).count() == 0


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_in_large_groups(spark, block, monkeypatch):
    """A hub of copies that are alike only through it, two groups in one bucket and a ring, against brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(8)
    some = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"e{rng.randrange(10**6)}"
        return words

    base, shared = some(300), some(60)
    hub = [base] + [edited(base, 6) for _ in range(200)]
    two = [shared + edited(b, 2) for b in (some(150), some(150)) for _ in range(30)]
    ring, words = [], some(300)
    for _ in range(40):
        words = edited(words, 6)
        ring.append(words)
    texts = [" ".join(t) for t in hub + two + ring]
    rng.shuffle(texts)
    want = brute_kept(texts)
    assert len(want) < 10
    assert kept_ids(spark, texts) == want


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """Rows that share a doc_id, or have none, are apart unless their texts are alike."""
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"v{rng.randrange(5000)}" for _ in range(80)) for _ in range(4))
    data = [(None, a, "en"), (None, b, "en"), (1, c, "en"), (1, d, "en"), (1, d, "en"), (2, a + " end", "en"), (None, c, "en"), (None, b, "en")]
    kept = simhash.deduplicated(frame(spark, data))
    assert rows(kept.select("doc_id", "text")) == sorted([(None, b), (1, c), (1, d), (2, a + " end")], key=repr)


def brute_segmentation(p, s):
    best = {0: 0.0}
    for j in range(1, len(s) + 1):
        best[j] = max((best[i] + (p.score[s[i:j]][0] if s[i:j] in p.score else p.unknown) for i in range(j) if s[i:j] in p.score or i == j - 1), default=-math.inf)
    return best[len(s)]


def value(p, v, ids, s):
    """The score of ids for the normal text s, characters in bytes as unknown."""
    runs = sum(v["scores"][i] for i in ids if i not in p.byte_of)
    return runs + p.unknown * sum(1 for c in s if c not in p.score)


def test_pieces(spark, odd, none, docs):
    v = pieces.vocabulary()
    p = pieces.Pieces(v)
    rng = random.Random(0)
    for text in ["the weather", "a\nb  c", "漢字 é", *("".join(rng.choice("the inon") for _ in range(40)) for _ in range(30))]:
        ids, s = p.encode(text), p.normal(text)
        assert p.decode(ids) == text and value(p, v, ids, s) == brute_segmentation(p, s)
    small = {r.doc_id: r.token_ids for r in pieces.encoded(docs, v).collect()}
    assert {r.doc_id: r.token_ids for r in pieces.encoded(docs, v, chunk=400).collect()} == small
    blob = "".join(rng.choice("abcdefghteiou") for _ in range(1500))
    df = frame(spark, [(1, blob, None), (1, blob, None), (2, None, None), (3, "x " * 900, None)])
    giant = pieces.encoded(df, v, chunk=100).collect()
    assert len(giant) == 4 and all(value(p, v, r.token_ids, "") == value(p, v, p.encode(blob), "") and p.decode(r.token_ids) == blob for r in giant if r.doc_id == 1)
    out = {r.doc_id: r for r in pieces.decoded(pieces.encoded(odd, v), v).collect()}
    assert all(out[d].decoded == (t or "").replace("▁", " ") and out[d].ids_crc32 == zlib.crc32(np.array(p.encode(t), "<u4").tobytes()) for d, t, _ in ODD)
    assert pieces.encoded(none, v).count() == 0


def test_pieces_of_giant_texts_do_not_depend_on_chunks(spark):
    v = pieces.vocabulary()
    p = pieces.Pieces(v)
    rng = random.Random(10)
    blobs = ["".join(rng.choice(letters) for _ in range(600)) for letters in ("abcdefghteiou", "aaab", "the", "\nhetanor", "漢字的一是") for _ in range(12)]
    want = {i: p.encode(t) for i, t in enumerate(blobs)}
    for chunk in (40, 97):
        got = {r.doc_id: r.token_ids for r in pieces.encoded(frame(spark, [(i, t, None) for i, t in enumerate(blobs)]), v, chunk=chunk).collect()}
        assert [i for i in want if got[i] != want[i]] == []


def test_language(spark, docs, odd, none):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    known = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert len(known) > 30 and np.mean([a == b for a, b in known]) > 0.95
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predicted(odd, model).collect()]
    assert len(out) == len(ODD) and all((p == "und") == (d in (1, 2, 3, 9)) and 0 <= s <= 1 for d, p, s in out)
    assert langid.predicted(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predicted(odd, langid.fit(none)).collect()} == {"und"}
    kept = langid.identified(frame(spark, [*ODD, *((100 + r.doc_id, r.text, r.lang) for r in docs.collect())]))
    assert kept.columns == none.columns and {r.doc_id for r in kept.collect() if r.doc_id < 100} <= {4, 5, 6, 7, 10}


def test_language_spans(docs):
    data = docs.collect()
    labeller = langid.Labeller(langid.train([(r.text, r.lang) for r in data]))
    a, b = (next(r.text for r in data if r.lang == k and 300 < len(r.text) < 3000) for k in ("de", "es"))
    spans = labeller.spans(f"{a} {b}")
    assert [s[0] for s in spans] == ["de", "es"] and abs(spans[1][1] - len(a)) < 30
    # the short way to a constant path gives what the whole search gives
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = np.log(rng.dirichlet([0.3] * 3, size=rng.integers(1, 30)) + 1e-5)
        best = max(score(s, q, 6.0) for q in candidates(s, 6.0))
        assert abs(score(s, labeller.path(s).tolist(), 6.0) - best) < 1e-9


def score(s, path, penalty):
    return sum(s[i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def candidates(s, penalty):
    best = {k: (s[0, k], [k]) for k in range(s.shape[1])}
    for t in range(1, len(s)):
        best = {k: max(((v + s[t, k] - penalty * (q[-1] != k), [*q, k]) for v, q in best.values()), key=lambda x: x[0]) for k in range(s.shape[1])}
    return [q for _, q in best.values()]


@pytest.mark.parametrize("table", [maxent.TABLE, 100])
def test_language_model(spark, docs, table):
    split = lambda t: [*words(t), None]
    data = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for d, t in data if zlib.crc32(str(d).encode()) % 7 != 2 for w in split(t))
    total = sum(counts.values())
    got = {r.doc_id: r for r in maxent.scored(docs, *maxent.fit(docs.where(~maxent.held_out()), table)).collect()}
    for d, t in data:
        r, w = got[d], split(t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), total, zlib.crc32(str(d).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution(docs):
    texts = [r.text for r in docs.collect()]
    h, c = np.unique(np.concatenate([h for _, h, _ in maxent.token_batches(texts)]), return_counts=True)
    keep = c > 1
    m = maxent.Model(h[keep], c[keep], int(c.sum()), len(h), int((c == 1).sum()))
    m.learn([texts])
    for _, t, sizes in maxent.token_batches(texts[:3]):
        p = np.exp(m.log_classes(m.features(t, sizes, m.class_of(*m.look_up(t)))).astype(float))
        assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    shares = np.bincount(m.classes, weights=10**m.share, minlength=maxent.CLASSES)
    assert np.allclose(shares[shares > 0], 1)


def test_language_model_edges(spark, odd, none):
    out = maxent.scored(odd, *maxent.fit(odd)).collect()
    assert len(out) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert maxent.scored(none, *maxent.fit(none)).count() == 0 and maxent.scored(odd, *maxent.fit(none)).count() == len(ODD)


def test_fingerprints(spark, docs, odd, none, tmp_path):
    def check(df):
        df.write.parquet(f"{(at := tmp_path / str(random.random()))}/documents.parquet")
        got = minhash.op10_fingerprints(spark, str(at)).collect()
        return sorted(got, key=lambda r: -r.doc_id)

    data = sorted(docs.collect(), key=lambda r: -r.doc_id)
    texts = [r.text for r in data]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    errors = []
    for i, (r, t) in enumerate(zip(check(docs), texts)):
        k, after = len(t) // 3, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for other, got in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingles(t), shingles(other)
            errors.append(got - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    out = check(odd)
    prints = {}
    assert len(out) == len(ODD)
    for r in out:
        text = dict((d, t) for d, t, _ in ODD)[r.doc_id] or ""
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 256
    assert check(none) == []
    (one,) = check(frame(spark, [(1, "a b c d e f", None)]))
    assert one.near_next == 1.0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.count())
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect())
