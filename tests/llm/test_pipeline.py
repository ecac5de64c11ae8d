"""The corpus pipeline, stage by stage and as a whole, against plain versions; clashing columns and odd rows in every stage."""

from __future__ import annotations

import ctypes
import hashlib
import os
import random
import shutil
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyframe.llm import common, language, lines, media, mixing, neardup, neighbours, packing, queries, tokens, toxicity

from . import plain

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(11)
    base = [prose(rng, rng.randint(20, 160), rng.choice(["en", "de", "fr"])) for _ in range(40)]
    shared = prose(rng, 12).replace("\n", " ")
    texts = base + [base[3], base[3], base[7] + " more words", f"{base[8]}\n{shared}", f"{shared}\n{base[9]}", f"{base[10]}\n{shared} again", "", None, "12345 ...", "!!!", "word"]
    rng.shuffle(texts)
    return [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def lettered(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def without_lines(rows):
    gone = plain.line_removals([r[1] for r in rows])
    out = []
    for r, g in zip(rows, gone, strict=True):
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in g) if g else r[1]
        out.append((r[0], text, *r[2:4], len(text) if g else r[4]))
    return out


def firsts(rows):
    return [r for i, (r, c) in enumerate(zip(rows, plain.near_classes([r[1] for r in rows]), strict=True)) if i == c]


def mixed(rows):
    taken = plain.mix([(r[0], r[1], r[3]) for r in rows])
    return [(r[0], t, *r[2:]) for r in rows for t in plain.mixed_texts(r[1] or "", taken[r[0]])]


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


PLAIN = {"language_id": lettered, "line_dedup": without_lines, "near_dedup": firsts, "mixing": mixed}


def test_stages_equal_plain_versions(spark, rows):
    now = rows
    for name, plain_stage in PLAIN.items():
        want = plain_stage(now)
        got = STAGES[name](spark, spark.createDataFrame(now, SCHEMA).repartition(3), "").collect()
        assert key(got) == key(want), name
        assert len(want) != len(now) or name == "line_dedup" and key(want) != key(now), name  # the stage does something here
        now = want


def test_run_equals_plain_versions(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = rows
    for stage in PLAIN.values():
        want = stage(want)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = [(r[0], [*t.encode(r[1], add_special_tokens=False).ids, 0]) for r in want]
    # every piece belongs to a copy of its document; sequences are full and gapless but for the last
    starts, by_sequence = defaultdict(Counter), defaultdict(list)
    crc = {(d, s, n): zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) for d, x in ids for s, n in [(r["start"], r["length"]) for r in got if r["doc_id"] == d]}
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(d, len(x)) for d, x in ids}
    for r in got:
        starts[r["doc_id"], r["doc_tokens"]][r["start"]] += 1
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for d, x in ids if d == r["doc_id"]), crc
    assert Counter({k: v[0] for k, v in starts.items()}) == Counter((d, len(x)) for d, x in ids)
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in ids)
    for s, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 1024 or s == max(by_sequence)


CLASHES = ["_language", "_gone", "_line_id", "_mix_id", "_mix_size", "_mix_taken", "_mix_words", "_kept", "_row_key", "_part", "_before", "sniffed_type", "uid", "bucket", "digest", "tokens", "curve_key", "part", "tie"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns_come_through(spark, rows, name):
    now = [r for r in rows[:25]] + [rows[0]]  # a repeated id, so that rows are numbered
    plain_docs = spark.createDataFrame(now, SCHEMA)
    docs = plain_docs
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(f"own {i}"))
    got = STAGES[name](spark, docs, "")
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    found = got.collect()
    assert found and all(r[c] == f"own {i}" for i, c in enumerate(CLASHES) for r in found)
    assert key(r[:5] for r in found) == key(STAGES[name](spark, plain_docs, "").collect())


def test_clashing_columns_of_the_operators(spark, rows):
    docs = spark.createDataFrame(rows[:20], SCHEMA)
    more = docs
    for c in ("_language", "digest", "uid", "label", "bands", "part", "tie", "curve_key", "score", "p", "f", "s", "id", "_id", "size", "taken", "first_id", "copy"):
        more = more.withColumn(c, F.lit("own"))
    for f in (language.identify_languages, neardup.near_duplicate_classes, lines.line_duplicates, mixing.mix_sources, media.text_media_features, lambda d: packing.pack_documents(d, queries.tokenizer_path("byte_bpe_50k.json"))):
        assert key(f(docs).drop("sequence_id", "offset").collect()) == key(f(more).drop("sequence_id", "offset").collect())
    blobs = spark.createDataFrame([(1, b"GIF89a", "x")], "id long, blob binary, sniffed string")
    with pytest.raises(ValueError, match="sniffed"):
        media.correct_types(blobs, "blob", "sniffed")


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_language_decoding_by_hand(spark):
    """Counts, codewords and losses worked out on three short texts."""
    train = [("aaab aaab", "x"), ("bbba bbba", "y"), ("cccd cccd", "z")]
    model = language.fit_language_model(spark.createDataFrame(train * 40, "text string, lang string"))
    texts = [t for t, _ in train]
    counts = []
    for t in texts:
        b = np.frombuffer(f"{t}".lower().encode(), np.uint8)
        column = common.text_column(__import__("pyarrow").array([t]))
        two, three, _ = language.grams(*common.buffers(language.folded(column)))
        counts.append(Counter(two.tolist()) + Counter(three.tolist()))
        assert len(b)
    seen = set().union(*counts)
    prior = language.SMOOTHING / len(seen) / 100
    for bit in range(model.code.shape[1]):
        for g in seen:
            one, zero = ([c[g] / sum(c.values()) for c, k in zip(counts, model.code[:, bit], strict=True) if k == side] for side in (1, 0))
            want = np.log(np.mean(one) + prior) - np.log(np.mean(zero) + prior)
            assert abs(model.weights[g, bit] - want) < 1e-4
    margin = language.margins(model, __import__("pyarrow").array(texts))
    best, score, _ = language.decode(model, margin)
    assert [model.languages[i] for i in best] == ["x", "y", "z"]
    for row, m in enumerate(margin):  # the least weighted loss over codewords
        odds = np.clip(m * model.scale + model.shift, -30, 30)
        loss = [sum(model.trust[b] * np.log1p(np.exp(-odds[b] if model.code[k, b] else odds[b])) for b in range(len(odds))) for k in range(3)]
        near = np.exp(-(np.array(loss) - min(loss)))
        assert int(np.argmin(loss)) == best[row] and abs(near.max() / near.sum() - score[row]) < 1e-9


def test_one_language_only(spark):
    docs = spark.createDataFrame([(i, "some text here", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify_languages(docs).collect()} == {"en"}


def test_most_frequent_languages_are_learned(spark, prose):
    rng = random.Random(2)
    rows = [(prose(rng, 30, lang), lang) for lang in ("en", "de") for _ in range(30)] + [(prose(rng, 30, "fr"), "rare")]
    model = language.fit_language_model(spark.createDataFrame(rows, "text string, lang string"), most_languages=2)
    assert model.languages == ["de", "en"]


def test_toxicity_weights_against_a_dense_fit():
    """The sparse steps equal the same steps on dense matrices, swaps and all."""
    rng = np.random.default_rng(3)
    n_rows, n = 24, 7
    values = rng.integers(0, 3, (n_rows, n))
    label = (values[:, 0] + rng.normal(size=n_rows) > 1).astype(float)
    label[:2] = 0, 1
    x = [np.flatnonzero(v).tolist() for v in values]
    counts = [v[v > 0].tolist() for v in values]
    minus = [[5] if i % 3 == 0 else [] for i in range(n_rows)]
    plus = [[6] if i % 3 == 0 else [] for i in range(n_rows)]
    w, b = toxicity.fit_weights(x, counts, minus, plus, label, n, counterfactual=2.0, steps=50)
    dense, swap = values.astype(float), np.zeros((8, n))
    swap[:, 5], swap[:, 6] = -1, 1
    u, c = np.zeros(n), np.log(label.mean() / (1 - label.mean()))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, 51):
        p = 1 / (1 + np.exp(-(dense @ u + c)))
        g = np.append(dense.T @ (p - label) / n_rows + 2e-5 * u + 2 * 2.0 / 8 * swap.T @ (swap @ u), (p - label).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        u, c = u - move[:-1], c - move[-1]
    assert np.allclose(w, u, atol=1e-9) and abs(b - c) < 1e-9


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, "you scum" if i % 2 else "fine day") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0)] * 500, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 60 and all(got[i] == i % 2 for i in got)


def test_items_come_by_offset(spark):
    mp4 = b"\x00\x00\x00\x10ftypisom\x00\x00\x00\x00" + b"\x00\x00\x00\x08free"
    blob = b"xx" + mp4 + b"yy"
    found = media.carve(blob)
    assert [i[0] for i in found] == sorted(i[0] for i in found) and found[0][:2] == (2, len(mp4))


def test_more_formats_end_where_they_say():
    body = b"\x01\x02\x03" * 5
    tail = b"HEADER"
    start = struct.pack("<QQI", len(body), len(tail), zlib.crc32(tail))
    seven = b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + tail
    ebml = b"\x1a\x45\xdf\xa3\x8b\x42\x82\x88matroska"
    mkv = ebml + b"\x18\x53\x80\x67\x84" + b"abcd"
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (273, 4, 1, 8), (279, 4, 1, 10)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    tiff = b"II*\x00" + struct.pack("<I", 18) + b"0123456789" + ifd
    frame = struct.pack(">I", 0xFFFB9000).ljust(417, b"\x00")
    mp3 = b"ID3\x03\x00\x00\x00\x00\x00\x05hello" + frame * 3
    for kind, item in (("application/x-7z-compressed", seven), ("video/x-matroska", mkv), ("image/tiff", tiff), ("audio/mpeg", mp3)):
        assert media.carve(b"some text " + item + b" and more") == [(10, len(item), kind, 0)], kind
        assert all(x[2] != kind for x in media.carve(b"some text " + item[:-1])) or kind == "audio/mpeg"
    assert media.carve(mkv[:-5] + b"\xff" + b"rest") == [(0, len(mkv), "video/x-matroska", 0)]  # unknown size: to the end
    for blob in (b"II*\x00", b"MM\x00*\xff\xff\xff\xff", b"ID3", b"7z\xbc\xaf\x27\x1c", b"\x1a\x45\xdf\xa3", b"\x1a\x45\xdf\xa3\x00", b"%PDF-" * 5000, b"PK\x03\x04" * 5000):
        assert media.carve(blob) == []


def test_bins_cover_all_lists():
    first, shards = neighbours.bins({0: 10, 1: 20_000, 2: 5, 3: 9000})
    assert shards == {0: 1, 1: 3, 2: 1, 3: 2} and len({first[1] + i for i in range(3)} & {first[0], first[2], first[3], first[3] + 1}) == 0


def test_rows_keys_are_unique(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, None), (1, "c")], "doc_id long, text string").repartition(3)
    got = sorted((r["k"], r["doc_id"] or -1, hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in common.with_row_keys(docs, "k").collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4] and [g[1] for g in got] == [-1, -1, 1, 3, 3]


def test_workers_forget_the_words_of_packing(spark, rows, tmp_path, monkeypatch):
    """After the last stage no worker holds a table of the words that it has met."""
    path = shutil.copy(queries.tokenizer_path("byte_bpe_50k.json"), tmp_path / "own.json")  # so no other test's table
    monkeypatch.setattr(corpus_pipeline, "tokenizer_path", lambda name: str(path))

    def held(batches):
        for _ in batches:
            known = tokens.encoder(str(path))
            yield pa.RecordBatch.from_arrays([pa.array([len(known.known) + len(known.aside)])], names=["n"])

    assert corpus_pipeline.pack(spark, spark.createDataFrame(rows, SCHEMA), "").count() >= len(rows)
    found = spark.range(0, 64, 1, 32).mapInArrow(held, "n long").agg(F.max("n")).first()[0]
    assert found == 0


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library can't give memory back")
def test_memory_of_a_task_goes_back_to_the_system():
    """What a task has freed below memory that is still held isn't kept by its worker; what the task forgets is forgotten even if it isn't read to the end."""
    code = """if True:
        import numpy as np, re
        from keyframe.llm import common

        def size():
            return sum(map(int, re.findall(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

        pinned, gone = [], []

        def work(batches):
            for batch in batches:
                held = [np.ones(6_000) for _ in range(3_000)]  # 48 kB each
                pinned.append(np.ones(6_000))
                yield batch

        before = size()
        assert list(common.giving_back(work)(iter([1, 2]))) == [1, 2]
        assert size() - before < 40, size() - before
        for _ in common.giving_back(work, lambda: gone.append(1))(iter([1, 2])):
            break
        assert gone == [1]
    """
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.abspath(corpus_pipeline.__file__))})
