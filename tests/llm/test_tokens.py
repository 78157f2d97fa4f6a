"""Token files, byte-level BPE and packing, against the libraries on whole texts."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vacantia.llm import best_fit, byte_bpe, token_files
from vacantia.llm.shared import folder
from vacantia.llm.units import Memory, UnitEncoder

KINDS = {"word_bpe_49k.json": "words", "byte_bpe_50k.json": "byte_level"}
LIBRARY = {f: Tokenizer.from_file(P.path(f)) for f in KINDS}
UNIT = {f: UnitEncoder(P.path(f), k) for f, k in KINDS.items()}
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
for _t in LIBRARY.values():
    _t.encode_special_tokens = True


def whole(file, text):
    return np.array(LIBRARY[file].encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'.,!?|#-_ \u00a0\u2003\x1c…éÉßİ\u0301aZ09s"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_units_give_the_ids_of_the_whole_text(text):
    for file in KINDS:
        assert UNIT[file].encode(text) == whole(file, text).tobytes()


def test_memory_is_bounded():
    seen = Memory(str.upper, bound=10, longest=3)
    assert [seen[str(i)] for i in range(50)] == [str(i) for i in range(50)] and seen["abcd"] == "ABCD"
    assert len(seen) <= 10 and len(seen.old) <= 10 and "abcd" not in seen


@pytest.mark.parametrize(("n", "top"), [(1, 0), (1, 9), (7, 0), (1500, 10**6), (600, 2**62), (20_000, 10**9), (8_192, 50), (8_193, 0), (0, 0)])
def test_elias_fano_round_trip(n, top):
    draw = random.Random(n)
    values = sorted(draw.randint(0, top) for _ in range(n))
    steps = array("Q", [b - a for a, b in zip(values, values[1:], strict=False)])
    slices = list(token_files._rising(steps, values[0])) if values else []
    assert [int(v) for part in slices for v in part] == values and all(len(part) == token_files.SLICE for part in slices[:-1])
    back, end = token_files.EliasFano.loads(b"xx" + (data := token_files.EliasFano.build(n, values[-1] if values else 0, slices).dumps()), 2)
    assert end == len(data) + 2 and [back.select(i) for i in range(n)] == values
    assert len(back.low) + len(back.high) <= n * (3 + max(1, top // max(n, 1)).bit_length()) / 8 + 16


def test_token_files_hold_every_document_in_order(spark, docs_of, odd_rows):
    root = folder(spark, "files")
    manifest = token_files.write(docs_of(odd_rows), root, P.path("word_bpe_49k.json"), "words", 1).cache()
    got = token_files.read_digests(manifest, root).collect()
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])][0] == 0
    expected = sorted((d if d is not None else -1, len(b := np.append(whole("word_bpe_49k.json", t), 1).astype("<u4")), zlib.crc32(b.tobytes())) for d, t in odd_rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    named = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert named == sorted(named, key=lambda d: -1 if d is None else d)
    shard = token_files.Shard(root, manifest.orderBy("start").first()["shard"])
    assert shard.doc_id(0) is None and shard.tokens(0).tolist() == [*whole("word_bpe_49k.json", odd_rows[2][1]).tolist(), 1]
    assert token_files.read_digests(token_files.write(docs_of([]), folder(spark, "files"), P.path("word_bpe_49k.json"), "words", 1), root).count() == 0


def test_byte_bpe_equals_the_library(docs_of, odd_rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    for token in list(ranks)[::97]:  # tokens as texts, also those that no merge reaches
        text = token.decode("utf-8", "ignore")
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    expected = []
    for d, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    rows = byte_bpe.round_trip(docs_of(odd_rows), RANKS, P.PATTERN).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    back = byte_bpe.decode(byte_bpe.encode(docs_of(odd_rows), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t in odd_rows)
    assert byte_bpe.round_trip(docs_of([]), RANKS, P.PATTERN).count() == 0


def test_lower_bounds_and_best_fit():
    draw = random.Random(3)
    for capacity in (10, 64, 1024):
        for _ in range(30):
            sizes = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 60))), reverse=True)
            where, free = best_fit.best_fit_decreasing(sizes, capacity)
            used = np.bincount(where, sizes, len(free))
            assert (used <= capacity).all() and (capacity - used == free).all()
            assert -(-sum(sizes) // capacity) <= best_fit.lower_bound(np.array(sizes), capacity) <= len(free)
    assert best_fit.lower_bound(np.array([6, 6, 6]), 10) == 3 and best_fit.lower_bound(np.array([], int), 10) == 0


def test_packing_keeps_ids_beyond_16_bits(docs_of, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    large = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    large.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    large.save(f"{tmp_path}/large.json")
    for file, units, text, ids, end in (
        (f"{tmp_path}/large.json", "words", "w5 w65535 w65536 w69999", [5, 65_535, 65_536, 69_999], 2),
        (P.path("byte_bpe_50k.json"), "byte_level", "", [], 70_000),
    ):
        (row,) = best_fit.pack(docs_of([(1, text)]), file, units, end, 256).collect()
        assert np.frombuffer(bytes(row["ids"]), "<u4").tolist() == [*ids, end] and row["ids_crc32"] == zlib.crc32(bytes(row["ids"]))


@pytest.mark.parametrize("group_rows", [3, 100_000])
def test_packing_is_whole_and_gapless(monkeypatch, docs_of, odd_rows, group_rows):
    monkeypatch.setattr(best_fit, "GROUP_ROWS", group_rows)
    rows = odd_rows + [(100 + i, "some words " * (i * 7 % 90)) for i in range(60)]
    got = best_fit.pack(docs_of(rows), P.path("byte_bpe_50k.json"), "byte_level", 2, 256).collect()
    sequences: dict[int, list] = {}
    docs: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = 0
    for d, t in rows:
        ids = np.append(whole("byte_bpe_50k.json", t), 2).astype("<u4")
        total += len(ids)
        if d == 4:
            continue
        assert [bytes(r["ids"]) for r in sorted(docs[d], key=lambda r: r["piece"])] == [ids[s : s + n].astype("<u2").tobytes() for s, n in best_fit.cut(len(ids), 256)]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in docs[d])
    assert len(docs[4]) == 2 and sum(r["length"] for r in got) == total
    assert len(sequences) <= 1.15 * -(-total // 256) + 2
    assert best_fit.pack(docs_of([]), P.path("byte_bpe_50k.json"), "byte_level", 2, 256).count() == 0
