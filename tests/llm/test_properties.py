"""Properties on generated input, without Spark."""

from __future__ import annotations

import math
import statistics

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lines, media, pieces, quality, shingles

MODEL = pieces.PieceModel()
TEXT = st.text(st.characters(exclude_categories=("Cs",)), max_size=200) | st.text("ab \n▁é\t", max_size=80)


@given(st.binary(max_size=5000))
def test_png_round_trip(data):
    assert media.from_png(media.to_png(media.padded(data))) == media.padded(data)


@given(st.lists(st.lists(st.sampled_from(["", "a", "bb", "ccc", " ", "d", "e"]), max_size=30), max_size=3))
def test_two_lines_have_the_same_boundary_wherever_they_stand(parts):
    texts = ["\n".join(p).encode() for p in parts]
    owner, v, start, stop, before, begins, after, ends = lines.boundaries(texts)
    by, count = {}, [0] * len(texts)
    for k in range(len(owner)):
        for h, a, b in ((before[k], begins[k], stop[k]), (after[k], start[k], ends[k])):
            if h != -1:
                chunk = texts[owner[k]][a:b].removesuffix(b"\n")
                full = [x for x in chunk.split(b"\n") if x.strip()]
                assert len(full) == 2 and chunk.startswith(full[0]) and chunk.endswith(full[1])
                assert by.setdefault(chunk, (v[k], h)) == (v[k], h)
                count[owner[k]] += 1
    assert len(set(by.values())) == len(by)
    assert count == [max(0, sum(bool(x.strip()) for x in p) - 1) for p in parts]


@settings(deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.sampled_from([0.0, 0.2, 1.0]))
def test_pieces_decode_to_the_text(texts, share):
    found = pieces.Encoder(MODEL, pieces.Dropout(share)).encode(texts, np.arange(len(texts)).astype(np.uint64))
    assert [MODEL.decode(x.tolist()).decode() for x in found] == texts


@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 4))
def test_shingle_sets_of_a_batch_equal_those_alone(texts, width):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    every = shingles.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), bounds, width)
    for r, found in zip(raw, every):
        words = r.decode().translate({c: c + 32 for c in range(65, 91)}).encode().split()
        wanted = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
        assert len(found) == len(wanted)
        assert (found == shingles.shingle_sets(np.frombuffer(r, np.uint8), np.array([0, len(r)]), width)[0]).all()


@given(st.lists(TEXT, min_size=1, max_size=6))
def test_passage_vectors_of_a_batch_equal_those_alone(texts):
    raw = [t.encode() for t in texts]
    x, owner = quality.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, r in enumerate(raw):
        assert np.allclose(x[owner == k], quality.encode(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0])


@given(st.binary(max_size=3000))
def test_features_of_a_payload_equal_plain_statistics(data):
    payload = media.padded(data)
    said = {k: float(v) for k, v in (x.split("=") for x in media.describe(payload).split(";"))}
    share = {b: payload.count(b) / len(payload) for b in set(payload)}
    wanted = {
        "mean": statistics.fmean(payload), "std": statistics.pstdev(payload), "entropy": -sum(p * math.log2(p) for p in share.values()), "zero": share.get(0, 0.0),
        "letters": sum(bytes([b]).isalpha() for b in payload) / len(payload), "high": sum(b > 127 for b in payload) / len(payload),
    }
    assert said.keys() == wanted.keys() and all(abs(said[k] - v) <= 0.51e-4 for k, v in wanted.items())
