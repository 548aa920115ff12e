"""Nulls, repeated rows, clashing names, empty tables, ties, settings and bounds of the training-data operators."""

import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import common, decontam, langid, maxent, minhash, pieces, sharding, simhash, tokenfiles, toxicity

DATA = "/root/testdata/sf0.001"
#: Names that operators might use for columns of their own.
CLASH = "doc_id bigint, text string, lang string, digest string, digest_of string, token_ids string, text_of string, giant_of string, bucket int, bad_id bigint, place bigint, window int, c0 string, n int"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, lang, "mine", "of", "ids", "x", "y", 7, 8, 9, 10, "z", 11) for d, t, lang in rows], CLASH)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_shared_folder(spark, monkeypatch):
    here = spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(spark).startswith(here)

    class Cluster:
        master, applicationId = "spark://host:7077", "app-1"

    class Session:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda *_: None)}), Cluster

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Cluster.master = "local[4]"
    assert common.shared_dir(Session).startswith("file:///")
    assert spark.conf.get("spark.checkpoint.dir") == here


def test_settings_are_put_back_and_tables_deleted(spark):
    import os

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, 5):
        assert spark.conf.get(key) == "5"
        1 / 0
    assert spark.conf.get(key) == before
    v = pieces.vocabulary()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pieces.encoded(docs, v, chunk=400)
    assert spark.conf.get(key) == before
    df = common.written(docs.limit(3), "some")
    at = df.written_to.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(at)
    common.removed(df, None, docs)
    assert not os.path.isdir(at)


def test_clashing_names_keep_their_values(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    data = [(1, long, "en"), (1, long, "en"), (2, "other words here", "en"), (None, None, None), (None, long, "en"), (3, "", "en")]
    docs, items = clashing(spark, data), spark.createDataFrame([(5, long), (None, "other words here")], "item_id bigint, text string")
    out = decontam.decontaminated(docs, items)
    assert out.columns == docs.columns and rows(out) == rows(docs.where("doc_id = 3 OR text IS NULL"))
    found = rows(decontam.contamination(docs, items).select("doc_id", "n_words", "n_hit", "items", "copies"))
    assert found == sorted([(1, 12, 12, [5], 2), (2, 3, 3, [], 1), (None, 0, 0, [], 1), (None, 12, 12, [5], 1), (3, 0, 0, [], 1)], key=repr)
    v = pieces.vocabulary()
    coded = pieces.encoded(docs, v, "pieces", chunk=20)
    assert coded.columns == [*docs.columns, "pieces"] and rows(coded.drop("pieces")) == rows(docs)
    assert sorted(pieces.encoded(docs, v).columns) == sorted(docs.columns)  # a column of that name is replaced
    assert rows(pieces.decoded(coded, v, "pieces").select("doc_id", "decoded")) == sorted([(d, t or "") for d, t, _ in data], key=repr)
    assert rows(simhash.deduplicated(docs).select("doc_id", "text", "digest")) == sorted([(1, long, "mine"), (2, "other words here", "mine"), (3, "", "mine")], key=repr)
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and rows(kept) == rows(docs.where("text <> ''"))
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id bigint, toxic int")
    assert rows(toxicity.cleaned(docs, labels)) == rows(docs)
    assert sharding.sharded(docs).count() == len(data) and simhash.linked(docs).count() == len(data)


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    text = "the cat sat on the mat. it was a fine day and all was well with them. " * 3
    data = [(1, text, "en"), (1, text, "en"), (2, None, None), (None, text + "more", "en"), (None, "", "en"), (4, " \n ", None), (5, "x" * 50_000, "en")]
    spark.createDataFrame([(1, 0, 0), (1, 0, 1), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words"), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(spark, data)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert set(out.columns) == {*docs.columns, "token_ids"}
            assert out.count() <= table.count()
            if name != "near_duplicates":
                assert out.where("text = '" + text + "'").count() == table.where("text = '" + text + "'").count()
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_are_letters():
    model = langid.train([("der hund und die katze", "de"), ("el perro y el gato", "es")])
    labeller = langid.Labeller(model)
    assert labeller.predict("½ ②") == ("und", 0.0) and labeller.predict("123 _ ٣") == ("und", 0.0) and labeller.predict(None) == ("und", 0.0)
    assert langid.words("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and langid.words("x½y Ⅷ ét") == ["x", "y", "ét"]
    rng = random.Random(2)
    alphabet = [c for c in map(chr, range(0x20, 0x3000)) if unicodedata.category(c)[0] in "LMNPZ"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet if rng.random() < 0.3 else "ab ßÉ½²1") for _ in range(12)).lower()
        assert langid.words(text) == langid.WORD.findall(text)


def test_samples_are_bounded(spark, monkeypatch):
    """A doc_id that is repeated without end, and as many labels, gather no more than the bound."""
    got = []
    monkeypatch.setattr(langid, "train", lambda found: got.append(found))
    monkeypatch.setattr(toxicity, "train", lambda found: got.append(found))
    docs = spark.range(4000).selectExpr("cast(7 AS bigint) AS doc_id", "if(id % 2 = 0, 'same', concat('text ', id)) AS text", "'en' AS lang")
    langid.fit(docs, 10)
    assert len(got[-1]) <= 20 and len(set(got[-1])) == len(got[-1])
    labels = spark.range(4000).selectExpr("if(id < 3000, 7, id) AS doc_id", "cast(id % 2 AS int) AS toxic")
    toxicity.fit(docs, labels, 10)
    assert len(got[-1]) <= 10


def test_toxicity_model_against_plain_loops():
    """The chosen words, and one step of the gradient of the noisy-or likelihood by differences."""
    rng = random.Random(1)
    texts = [(". ".join(" ".join(rng.choice("ab cd ef gh vile".split()) for _ in range(3)) for _ in range(3)), rng.randint(0, 1)) for _ in range(60)]
    model = toxicity.train(texts, rounds=1, rate=0.5, l2=0.0)
    y = np.array([v for _, v in texts])

    def loss(bias, weights):
        total = 0.0
        for (text, v) in texts:
            keep = 1.0
            for s in toxicity.sentences(text):
                z = bias + sum(weights.get(f, 0.0) for w in set(s.split()) for f in toxicity.features(w))
                keep *= 1 - 1 / (1 + math.exp(-z))
            total += math.log(1 - keep) if v else math.log(keep)
        return total / len(y)

    start = math.log(1e-3)
    for name, w in model["weights"].items():
        slope = (loss(start, {name: 1e-4}) - loss(start, {name: -1e-4})) / 2e-4
        want = 0.5 * slope / math.sqrt(1e-8 + slope * slope)
        assert abs(w - want) < 1e-3, name
    scorer = toxicity.Scorer({"bias": -1.0, "weights": {"vile": 2.0, "vile*": 1.0}})
    p = [1 / (1 + math.exp(-z)) for z in (-1.0, 2.0)]
    assert abs(scorer.score("ab cd. vile ef") - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-12


def test_shards_are_balanced(spark):
    """In levels and directly, against direct differencing of the same groups."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = {}
    for r in docs.select("doc_id", "text").collect():
        sizes[r.text] = sizes.get(r.text, 0) + len((r.text or "").encode()) + 8
    direct = np.bincount(sharding.differencing(sorted(sizes.values())), weights=sorted(sizes.values()), minlength=24)
    found = sharding.sharded(docs).groupBy("shard").sum("size").collect()
    share = sum(sizes.values()) / 24
    assert np.ptp([r[1] for r in found]) <= max(np.ptp(direct) + 8, 0.001 * share) and len(found) == 24


def test_shards_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINAL", 40)
    monkeypatch.setattr(sharding, "BATCH", 50)
    rng = random.Random(3)
    data = [(i if i % 9 else None, "x" * int(rng.paretovariate(1.2) * 20)) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    out = sharding.sharded(df, 4).collect()
    by = [[r for r in out if r.shard == k] for k in range(4)]
    sums = [sum(r["size"] for r in b) for b in by]
    assert len(out) == 3000 and all(sorted(r.slot for r in b) == list(range(len(b))) for b in by)
    groups = {}
    for _, t in data:
        groups[t] = groups.get(t, 0) + len(t) + 8
    assert max(sums) - min(sums) <= max(max(groups.values()) - sum(sums) / 4, 0) * 2 + 0.02 * sum(sums) / 4


def test_next_document_with_null_and_equal_ids(spark, tmp_path):
    import hashlib

    data = [(9, "a b c d e f"), (5, "g h i j k l"), (None, "m n o p q r"), (5, "g h i j k l"), (None, None), (-3, "s t u v w x y z")] + [(i, f"text {i} " * 3) for i in range(20, 120)]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest())
    order = [t or "" for _, t in sorted(data, key=key)]
    edited = lambda t, after: t[: len(t) - len(t) // 3] + after[: len(t) // 3]
    want = sorted(hashlib.sha256(edited(t, order[(i + 1) % len(order)]).encode()).hexdigest() for i, t in enumerate(order))
    for buckets in ("1", "5", "40"):
        with common.setting(spark, spark__sql__shuffle__partitions=buckets):
            assert sorted(r.edited_sha256 for r in minhash.op10_fingerprints(spark, str(tmp_path)).collect()) == want


def test_sent_models_are_destroyed(spark, monkeypatch):
    """The driver keeps no blocks of the models it sent, whose results are written."""
    from pyspark import Broadcast

    gone, real = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **k: (gone.append(self), real(self, *a, **k))[1])
    docs = spark.createDataFrame([(i, f"some words {i % 7} and more") for i in range(60)], "doc_id bigint, text string")
    out = maxent.scored(docs, *maxent.fit(docs.where(~maxent.held_out())))
    assert len(gone) == maxent.ROUNDS + 1 and out.count() == 60


def test_ranges_of_next_documents_have_a_task_each(spark, tmp_path, monkeypatch):
    """Tasks after the shuffle follow the bytes of the texts and are even, whatever the number of partitions set."""
    monkeypatch.setattr(minhash, "RANGE", 2500, raising=False)
    data = [(7 * i, f"text {i:04} of twenty by") for i in range(2000)]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with common.setting(spark, spark__sql__shuffle__partitions="4"):
        out = minhash.op10_fingerprints(spark, str(tmp_path))
        sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2000 and len([n for n in sizes if n]) == -(-sum(len(t) for _, t in data) // 2500)
    assert max(sizes) < 1.5 * 2000 / len(sizes)


def test_bins_and_densification_against_plain_loops(spark):
    """Bins of the minimum, and the values that empty bins take."""
    import re

    texts = ["", "one", "a b c d e f g", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 700}" for i in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    hashed = {r[0]: (r[1], r[2]) for r in df.selectExpr("doc_id", "transform(filter(split(lower(text), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w)) AS w").selectExpr("doc_id", "w", "IF(size(w) >= 5, transform(sequence(0, greatest(size(w) - 5, 0)), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])), array(xxhash64(w))) AS h").collect()}
    cross = {(a, b): h for a, b, h in spark.range(128).selectExpr("cast(id AS int) AS b").crossJoin(spark.range(128).selectExpr("cast(id AS int) AS f")).selectExpr("b", "f", "xxhash64(b, f) AS h").collect()}
    for r in minhash.fingerprinted(df, "text", "print").collect():
        bins = {}
        for h in hashed[r.doc_id][1]:
            k = (h & (2**64 - 1)) >> 57
            bins[k] = min(bins.get(k, h), h)
        # the choice of a filled bin: the least hash of the two numbers, its low byte aside
        full = lambda b: bins[b] & 255 if b in bins else bins[min(bins, key=lambda f: (cross[b, f] & ~255, bins[f] & 255))] & 255
        assert list(r["print"]) == [full(b) for b in range(128)], re.sub(r"\s.*", "", r.text)


def test_pieces_and_the_library(spark):
    """The library decodes the ids to the same text, and its own have no greater sum."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp, v = SentencePieceProcessor(model_file=public_tokenizers.path(pieces.FILE)), pieces.vocabulary()
    p = pieces.Pieces(v)
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for text in [*docs, "漢字 é\n\n😀  b", "x" * 300]:
        ids = p.encode(text)
        assert sp.decode(ids) == text == p.decode(ids)
        assert p.sum(np.array(sp.encode(text), int)) <= p.sum(np.array(ids, int))


def test_units_in_lanes_against_plain_search():
    p = pieces.Pieces(pieces.vocabulary())
    rng = random.Random(4)

    def plain(s):
        best, back = [0.0] + [-math.inf] * len(s), [0] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            for size in range(min(p.longest, j), 0, -1):
                cost = p.score[s[j - size : j]][0] if s[j - size : j] in p.score else p.unknown if size == 1 else -math.inf
                if best[j - size] + cost > best[j]:
                    best[j], back[j] = best[j - size] + cost, size
        return p.spelled(s, back, len(s))

    units = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 70))) for letters in ("abcdefghteiou", "aaab", "the", "\nhetanor▁", "漢字的一是é😀", "the▁ inon") for _ in range(80)]
    assert [np.frombuffer(b, "<i4").tolist() for b in p.solved(units)] == [plain(u) for u in units]


def test_matrices_combine_in_any_order():
    rng = np.random.default_rng(0)
    m = np.where(rng.random((13, 5, 5)) < 0.4, -math.inf, rng.integers(-20, 0, (13, 5, 5)).astype(float))
    m[:, 0, 0] = -1.0
    row, want = np.array([0.0] + [-math.inf] * 4), []
    for x in m:
        want.append(row)
        row = (row[:, None] + x).max(axis=0)
    assert np.array_equal(pieces.arriving(m), np.array(want))
    assert np.array_equal(pieces.combined(pieces.combined(m[0], m[1]), m[2]), pieces.combined(m[0], pieces.combined(m[1], m[2])))


def test_language_model_against_plain_loops(spark, monkeypatch):
    """score of whole documents from the trained weights, one token at a time; words in and beyond the table, and unseen."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").limit(40)
    model, counts = maxent.fit(docs.where(~maxent.held_out()), 300)
    known, k = {r.h: r.c for r in counts.collect()}, 0x9E3779B97F4A7C15
    place = {int(w): i for i, w in enumerate(model.words)}
    low64 = 2**64 - 1
    class_of = lambda h: int(model.classes[place[h]]) if h in place else maxent.CLASSES - 1
    assert np.abs(model.weights).sum() > 0 and len(place) <= 300 < len(known)
    got = {r.doc_id: r.score for r in maxent.scored(docs, model, counts).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        h, total = maxent.hashes(text), 0.0
        for i, w in enumerate(h):
            one, two = (h[i - 1] if i > 0 else 0), (h[i - 2] if i > 1 else 0)
            before = [class_of(h[i - j]) if i >= j else maxent.CLASSES for j in range(1, 5)]
            shift, side, first = 64 - model.bits, maxent.CLASSES + 1, 1 << model.bits
            rows = [(one * k & low64) >> shift, ((one ^ (two * k & low64)) * k + (1 << 60) & low64) >> shift]
            rows += [first + before[0] * side + before[1], first + side * side + before[2] * side + before[3]]
            z = model.prior.astype(float) + sum(model.weights[r].astype(float) for r in rows)
            total += (z[class_of(w)] - np.log(np.exp(z).sum())) / math.log(10)
            signed = w - 2**64 if w >> 63 else w
            total += model.share[place[w]] if w in place else math.log10(known.get(signed, model.unseen) / (model.rare + model.unseen))
        assert abs(got[d] - total) < 1e-3 * max(1, len(h)) ** 0.5, d


def test_language_model_learns_from_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learning = docs.where(~maxent.held_out())
    model, counts = maxent.fit(learning)
    held = docs.where(maxent.held_out())
    per_token = lambda: [sum(r[0] for r in x) / sum(r[1] for r in x) for x in [maxent.scored(held, model, counts).select("score", "n_tokens").collect()]][0]
    trained = per_token()
    model.weights = np.zeros_like(model.weights)
    assert trained - per_token() > 0.17


def test_weights_are_summed_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FAN", 3)
    rng = np.random.default_rng(1)
    values = rng.integers(-9, 9, (40, 2, 5)).astype(np.float16)
    parts = spark.createDataFrame([(i, s, i + 1, values[i, s].tobytes()) for i in range(40) for s in range(2)], "part int, stretch int, n bigint, moved binary")
    found = {r["stretch"]: r for r in maxent.averaged(parts, 39)}
    want = (values.astype(np.float32) * np.arange(1, 41, dtype=np.float32)[:, None, None]).sum(axis=0)
    assert len(found) == 2 and all(np.array_equal(np.frombuffer(found[s]["moved"], np.float32), want[s]) and found[s]["n"] == 820 for s in found)
    assert maxent.averaged(parts.limit(0), 39) == []


def test_workers_hold_little_of_what_they_split_and_kept():
    import tracemalloc

    import pyarrow as pa

    p = pieces.Pieces(pieces.vocabulary())
    texts = [f"the cat sat on mat {i % 7} " * 200 for i in range(200)]
    want = [np.frombuffer(p.encoded([t])[0], "<i4").tolist() for t in texts[:7]]
    tracemalloc.start()
    got = p.encoded(texts)
    peak = tracemalloc.get_traced_memory()[1] - sum(map(len, got))
    tracemalloc.stop()
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [want[i % 7] for i in range(200)]
    assert peak < 6 << 20  # about 240,000 units; as strings all at once 20 MB
    v = {"pieces": ["a", "<0x41>"], "scores": [0.0, 0.0], "special": [False, False], "bytes": [False, True]}
    assert pieces.loaded(v) is pieces.loaded(dict(v))
    common.released()
    assert not common.lasting
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], names=["x"])
    assert [b.column(0).to_pylist() for b in common.parts([batch, batch.slice(0, 0)])] == [list(range(i, min(600, i + 256))) for i in (0, 256, 512)]


def test_stages_of_the_pipeline_send_few_texts_to_python_at_a_time(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    data = [(i, f"the cat sat on the mat of house {i}" if i % 2 else f"le chat dort dans la maison {i}", "en" if i % 2 else "fr", None) for i in range(2500)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, written_to string").coalesce(1)
    docs.select("doc_id", F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    seen, kind = str(tmp_path / "seen"), type(docs)

    def watched(df, f, schema, *more, sent=kind.mapInArrow, **named):
        def noted(batches):
            for b in batches:
                with open(seen, "a") as to:
                    to.write(f"{b.num_rows}\n")
                yield b

        return sent(df, lambda batches: f(noted(batches)), schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    before = spark.conf.get(key)
    for stage in (corpus_pipeline.language, corpus_pipeline.toxic):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 2500
        with open(seen) as f:
            sizes = [int(x) for x in f]
        os.remove(seen)
        assert sum(sizes) == 2500 and max(sizes) <= 1000  # of the default settings one batch of 2,500
        assert spark.conf.get(key) == before
        common.removed(docs, out)


def test_language_looks_each_word_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *x):
            self.asked += 1
            return super().get(*x)

    assert langid.grams("été") == ["é", "t", "é", "<é", "ét", "té", "é>", "<ét", "été", "té>", "<été", "été>"]
    labeller = langid.Labeller(langid.train([("der hund und die katze", "de"), ("el perro y el gato", "es")]))
    labeller.ids = Counted()
    text = ["der", "gato", "und", "der", "neu", "gato"] * 5
    got = labeller.scores_of(text)
    assert labeller.ids.asked == len(text) and list(labeller.ids) == ["der", "gato", "und", "neu"]
    for w, row in zip(text, got):
        g = [labeller.matrix[labeller.rows.get(x, len(labeller.rows))].astype(np.float64) for x in langid.grams(w)]
        s = sum(g) / math.sqrt(len(g))
        s = s - s.max()
        assert np.allclose(row, np.maximum(s - np.log(np.exp(s).sum()), -12.0))


def test_words_are_encoded_once_and_as_in_whole_texts(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(tokenfiles.FILE)
    memory, library = tokenfiles.Tokens(path), tokenfiles.Tokens(path).tokenizer
    whole = lambda texts: [[*e.ids, tokenfiles.END_ID] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokenfiles, "KEPT_WORDS", 20_000, raising=False)
    # any character may stand before, between and after spaces
    signs = [chr(c) for c in (*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F400))]
    texts = [t for c in signs for t in (f"{c} a{c} {c}b 's{c}", f"a {c} ")] + ["", " ", "x<|endoftext|> y", "x <|endo ftext|> <|endoftext|>"]
    for i in range(0, len(texts), 1000):
        assert [x.tolist() for x in memory.encode(texts[i : i + 1000])] == whole(texts[i : i + 1000])

    class Spy:
        chars = 0

        def encode_batch_fast(self, texts, **how):
            Spy.chars += sum(map(len, texts))
            return library.encode_batch_fast(texts, **how)

    memory.tokenizer = Spy()
    texts = [" ".join(f"Wort{(i * k) % 97}," for k in range(300)) for i in range(50)]
    assert [x.tolist() for x in memory.encode(texts)] == whole(texts)
    assert Spy.chars < 0.1 * sum(map(len, texts))


def test_coder_asks_once_an_id(monkeypatch):
    rng, asked = np.random.default_rng(3), []
    for kind in (tokenfiles.Writer, tokenfiles.Reader):
        monkeypatch.setattr(kind, "bit", lambda self, *args, own=kind.bit: asked.append(1) or own(self, *args))
    block = rng.zipf(1.5, 3000).clip(0, 60).astype(np.uint16)
    (code,) = tokenfiles.encode_blocks([block])
    assert len(asked) <= len(block) and np.array_equal(tokenfiles.decode_blocks([code], [len(block)])[0], block) and len(asked) <= 2 * len(block)


def test_damaged_blocks_harm_no_other():
    rng = np.random.default_rng(4)
    blocks = [rng.permutation(65536)[:4096].astype(np.uint16), rng.integers(0, 65536, 4096).astype(np.uint16), np.repeat(np.arange(64, dtype=np.uint16), 64), rng.zipf(1.3, 4096).clip(0, 65535).astype(np.uint16), np.full(4096, 7, np.uint16)]
    codes, lengths = tokenfiles.encode_blocks(blocks), list(map(len, blocks))
    # alone or with others, each block has the same words
    assert all(np.array_equal(c, tokenfiles.encode_blocks([b])[0]) for b, c in zip(blocks, codes))
    for _ in range(12):
        k = int(rng.integers(len(codes)))
        damaged = [c.copy() for c in codes]
        at = int(rng.integers(2)) and int(rng.integers(len(damaged[k])))
        damaged[k][at:] = rng.integers(0, 65536, len(damaged[k]) - at)
        back = tokenfiles.decode_blocks(damaged, lengths)
        assert all(np.array_equal(blocks[i], back[i]) for i in range(len(blocks)) if i != k) and len(back[k]) == lengths[k]


def test_line_ends_and_marks_make_no_new_words(monkeypatch):
    """Words that end lines or have marks behind them are put together from what is known, and all ids are the library's."""
    import public_tokenizers

    path = public_tokenizers.path(tokenfiles.FILE)
    memory, library = tokenfiles.Tokens(path), tokenfiles.Tokens(path).tokenizer
    whole = lambda texts: [[*e.ids, tokenfiles.END_ID] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    signs = ["a", "a.", "é,", "1.", "e\u0301.", "it's.", "\n", "\n\n", " ", "  ", "\t", "\x85", "'", "!", "\u6f22."]
    for i in signs:
        texts = [i + j + k + m for j in signs for k in signs for m in signs]
        assert [x.tolist() for x in memory.encode(texts)] == whole(texts)
    words = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    memory.encode([" ".join(words), "\n".join(words)])
    seen = []

    class Spy:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **how)

    memory.tokenizer = Spy()
    texts = [" ".join(f"{a}{m}\n{b}{m}" for a, b in zip(words, words[k:] + words[:k])) for k, m in ((3, "."), (7, ",!"), (11, ""))]
    assert [x.tolist() for x in memory.encode(texts)] == whole(texts)
    assert sum(map(len, seen)) < 100


def test_decoding_holds_no_table_of_shares():
    import tracemalloc

    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 50, 300).astype(np.uint16) for _ in range(512)]
    codes = tokenfiles.encode_blocks(blocks)
    tracemalloc.start()
    back = tokenfiles.decode_blocks(codes, [300] * 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(map(np.array_equal, blocks, back))
    assert peak < 2 * len(blocks) * tokenfiles.SHARES


def test_coder_makes_few_calls_a_place():
    """Work at each place of a block is what the CPU seconds of op3 go to; what does not need the place before is done for many at a time."""
    import sys

    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.3, 4096).clip(0, 65535).astype(np.uint16) for _ in range(8)]
    calls, codes, back = [0, 0], [], []

    def run(k, f):
        def count(*_):
            calls[k] += 1

        sys.setprofile(count)
        try:
            return f()
        finally:
            sys.setprofile(None)

    codes = run(0, lambda: tokenfiles.encode_blocks(blocks))
    back = run(1, lambda: tokenfiles.decode_blocks(codes, [4096] * 8))
    assert all(map(np.array_equal, blocks, back))
    assert calls[0] < 80 * 4096 and calls[1] < 120 * 4096, calls


def test_shares_are_powers_of_two_and_found_again():
    rng = np.random.default_rng(6)
    counts = [np.ones(4096), [4096], [1, 1], rng.multinomial(4096, rng.dirichlet(np.full(600, 0.3))), [3000, 1000, 90, 3, 1, 1, 1], np.full(1365, 3)]
    for own in (np.array(c, np.int64)[np.array(c) > 0] for c in counts):
        kinds = np.sort(tokenfiles.CLASSES[own])[::-1][None]
        write, read = (tokenfiles.Zero(kinds, np.array([len(own)]), search) for search in (False, True))
        first, kind = write.firsts[: len(own)].astype(np.int64), write.kinds[: len(own)].astype(np.int64)
        assert (first % (1 << kind) == 0).all() and (first[1:] >= (first + (1 << kind))[:-1]).all()
        assert first[-1] + (1 << kind[-1]) == read.total[0] == write.total[0] <= tokenfiles.SHARES
        for share in (first, first + (1 << kind) - 1):
            cell = read.table[share >> 3].astype(np.int64)
            assert np.array_equal((cell >> 4) + ((share & 7) >> (cell & 15)), np.arange(len(own))) and np.array_equal(cell & 15, kind)


def test_words_of_letters_are_cut_without_the_rules():
    import public_tokenizers

    memory = tokenfiles.Tokens(public_tokenizers.path(tokenfiles.FILE))
    library, seen = memory.tokenizer, []

    class Spy:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **how)

    memory.tokenizer = Spy()
    texts = ["x " + " ".join(f"{a}{b}{c}" for b in "aEté" for c in ("on", "ing", "Ġ", "ß", "'s", "1", "S")) for a in ("th", "Wort", "Q", "lys")]
    assert [x.tolist() for x in memory.encode(texts)] == [[*e.ids, 0] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert not any(f" {w}" in s for s in seen for w in ("thaon ", "WortEing ", "QtS "))
