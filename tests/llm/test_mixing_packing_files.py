"""Mixing against a plain fold, packing and token files as exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from keyframe.llm import arrowfiles, media, mixing, packing
from keyframe.llm.queries import tokenizer_path
from keyframe.llm.tokens import Encoder


def whole_ids(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


@pytest.fixture(scope="module")
def docs(spark, prose):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 300)), rng.choice(["b", "a", None, "é", "c"]) if i % 3 else "a") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_equals_fold(docs):
    rows = docs.collect()
    size = {r["doc_id"]: len(r["text"].split()) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[r["doc_id"]] for r in by[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:  # fill, cap, share the excess again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    for s in order:
        epochs, words = int(target[s] // total[s]), 0
        rest = round(target[s] - epochs * total[s])

        def key(r):
            u = (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            n = size[r["doc_id"]]
            return -math.log(u) / (0.5 + 1 / (1 + abs(len(r["text"]) / n - 5.5)) if n else 1.0)

        for r in sorted(by[s], key=key):
            part = max(0, min(size[r["doc_id"]], rest - words))
            words += size[r["doc_id"]]
            g = got[r["doc_id"]]
            assert (g["size"], g["taken"]) == (size[r["doc_id"]], epochs * size[r["doc_id"]] + part)
            assert math.isclose(g["target"], target[s]) and g["source_size"] == total[s]


def test_mixed_documents(docs):
    plan = mixing.mix_sources(docs)
    taken = {r["doc_id"]: r["taken"] for r in plan.collect()}
    words = defaultdict(int)
    for r in mixing.mixed_documents(docs, plan).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {k: v for k, v in taken.items() if v}


def test_mix_odd(odd_docs, no_docs):
    assert mixing.mix_sources(odd_docs).count() == odd_docs.count()
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs, mixing.mix_sources(odd_docs)).columns == odd_docs.columns


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_tokenizers_ids(name, odd_texts, prose):
    rng = random.Random(1)
    more = ["don't, we'll.", "12.5, 3,", "foo.. bar,, baz.,", " lead", "a,\nb.\n", "ΑΣ, ΣΑΣ İ.", "a b\x85c", "x y", *("".join(rng.choice("ab .,\n'!é1") for _ in range(60)) for _ in range(200)), prose(rng, 500)]
    texts = [t or "" for t in odd_texts] + more
    got = Encoder(tokenizer_path(name)).encode(texts * 2)
    want = whole_ids(name, texts, 0)
    assert all((np.frombuffer(g, "<u2") == w[:-1]).all() and len(g) == 2 * len(w) - 2 for g, w in zip(got, want * 2, strict=True))


def test_new_words_are_encoded_in_a_row(monkeypatch):
    """Words behind a space are learnt as one text, cut where a token opens with a space; others one by one. Both give the tokenizer's ids."""
    name, alone, apart = "byte_bpe_50k.json", [], Encoder._apart
    monkeypatch.setattr(Encoder, "_apart", lambda self, keys: alone.extend(keys) or apart(self, keys))
    texts = ["First Ġtwo ĠĠ x̄y. it's 12ab%% ,.", "Ġ again, new\nLine and\n", "trailing space ", " lead  run", "日本 語 😀 <|endoftext|> a"]
    got = Encoder(tokenizer_path(name)).encode(texts)
    want = [x[:-1].tolist() for x in whole_ids(name, texts, 0)]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    assert all(k[:1] in ("", "\x00", "\n", ".", ",") for k in alone) and any(k[:1] == "\x00" for k in alone)
    monkeypatch.setattr(Encoder, "_in_a_row", Encoder._apart)
    assert Encoder(tokenizer_path(name)).encode(texts) == got


def test_packing_round_trip(docs):
    got = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    ids = dict(zip([r["doc_id"] for r in docs.collect()], whole_ids("byte_bpe_50k.json", [r["text"] for r in docs.collect()], 0), strict=True))
    by_sequence, by_doc = defaultdict(list), defaultdict(int)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]] += r["length"]
    assert by_doc == {k: len(v) for k, v in ids.items()}
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for offset, n in sorted(by_sequence[s]):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(n == 1024 for n in sizes[:-1]) and 0 < sizes[-1] <= 1024


def test_packing_odd(odd_docs, no_docs):
    assert packing.pack_documents(no_docs, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert packing.pack_documents(odd_docs, tokenizer_path("byte_bpe_50k.json")).where("start = 0").count() == odd_docs.count()


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(side, 3)
    assert sorted(key) == list(range(512))
    path = side[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_token_files(spark, docs, odd_docs, no_docs):
    files = arrowfiles.write_token_files(docs.repartition(3), tokenizer_path("word_bpe_49k.json"), 2, length=64, partitions=3)
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    want = whole_ids("word_bpe_49k.json", [r["text"] for r in rows], 2)
    start = 0
    for r, w in zip(arrowfiles.read_token_files(files).orderBy("doc_id").collect(), want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(w), zlib.crc32(w.tobytes()))
        start += len(w)
    flat = np.concatenate(want)
    opened = arrowfiles.open_files(spark, files)
    assert sum(f.n_tokens for f in opened) == len(flat)
    ids, mask = opened[0].sequence(1)
    assert (ids == flat[64:128]).all() and mask.all() and not ids.flags.owndata
    digest = arrowfiles.token_file_digest(odd_docs, tokenizer_path("word_bpe_49k.json"), 2)
    assert digest.count() == odd_docs.count()
    assert arrowfiles.token_file_digest(no_docs, tokenizer_path("word_bpe_49k.json"), 2).count() == 0


def test_samples_round_trip(odd_docs, no_docs, odd_texts):
    for r in media.text_media_features(odd_docs.where("doc_id IS NOT NULL")).collect():
        data = (odd_texts[r["doc_id"]] or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-16:]) and r["feature"].startswith("audio/wav;")
    assert media.text_media_features(no_docs).count() == 0


def test_sniffing(spark):
    import io
    import zipfile

    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", b"\0" * 13), (b"IDAT", zlib.compress(b"\0")), (b"IEND", b"")))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.png", png)
    wav = media.wav_header(4) + b"abcd"
    blobs = [(1, png, "image/gif"), (2, b"junk" + png + b"tail", "text/plain"), (3, buffer.getvalue(), "x"), (4, b"BM not a picture RIFF", "text/plain"), (5, None, "y"), (6, b"", "z"), (7, wav, "audio/mpeg"), (8, png[:-6], "image/png")]
    df = spark.createDataFrame(blobs, "id int, blob binary, declared string")
    got = media.correct_types(df, "blob", "declared")
    kinds = {r["id"]: r["declared"] for r in got.collect()}
    assert kinds == {1: "image/png", 2: "text/plain", 3: "application/zip", 4: "text/plain", 5: "y", 6: "z", 7: "audio/wav", 8: "image/png"}
    parts = media.embedded(got, "id", "blob").collect()
    assert {(r["id"], r["type"], r["depth"], bytes(r["bytes"]) == png) for r in parts} == {(2, "image/png", 0, True), (3, "image/png", 1, True)}
    assert {r["id"]: r["sniffed"]["type"] for r in got.collect()}[8] == media.UNKNOWN


def test_items_that_hold_ends_of_others():
    import io
    import struct
    import zipfile

    def archive(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    def pdf(body, before=b"%PDF-1.4\n"):
        at = len(before) + len(body)
        return before + body + b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF" % at

    size = lambda blob, at=0: next((n for a, n, *_ in media.carve(blob) if a == at), None)
    inner = archive(a=b"text")
    outer = archive(x=inner, y=b"more", z=inner)
    assert size(outer) == len(outer) and size(outer, outer.index(inner)) == len(inner)
    assert size(outer + inner) == len(outer) and size(b"?" * 7 + outer + b"??", 7) == len(outer)

    one = pdf(b"1 0 obj\nendobj\n")
    two = pdf(b"\n2 0 obj\nendobj\n", one)
    line = pdf(b"1 0 obj\nendobj\nxref\nstartxref\n0\n%%EOF\n2 0 obj\nendobj\n")
    held = pdf(b"1 0 obj\nstream\n" + two + b"\nendstream\nendobj\n")
    for whole in (one, two, line, held):
        assert size(whole) == len(whole) and size(whole + b"\n" + one) == len(whole) and size(whole + whole, len(whole)) == size(whole + whole) == len(whole)
    assert size(held, held.index(two, 1)) == len(two)

    head = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\2\0")
    long = head + struct.pack(">I4sQ", 1, b"mdat", 16 + 300) + bytes(300) + struct.pack(">I4s", 8, b"free")
    assert size(long) == len(long) and size(long + b"??") == len(long)
    rest = head + struct.pack(">I4s", 0, b"mdat") + bytes(range(256))
    assert size(rest) == len(rest) and size(head + bytes(30)) == len(head)
