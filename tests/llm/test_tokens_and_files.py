import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyproof.llm import idfiles, packing, tokens
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab C'sd.,!9é日  \x85\x1c \n\t", max_size=40), min_size=1, max_size=5))
def test_stretches_give_the_ids_of_whole_texts(texts):
    encoder = tokens.encoder(tokens.default_path())
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(encoder, t) for t in texts]


def test_special_strings_and_nulls(encoder):
    texts = ["a <|endoftext|> b", None, "", "don't  stop"]
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(encoder, t) for t in texts]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("top", [1, 255, 256, 50_256, 2**32 - 1])
def test_planes_round_trip(bits, top, tmp_path):
    rng = np.random.default_rng(top)
    counts = np.array([0, 5, 1, 999, 0])
    ids = rng.integers(0, top, int(counts.sum()), endpoint=True).astype(np.uint32)
    data = idfiles.pack_image([None, -3, 2, 9, 10], counts, ids, bits=bits, block=64)
    idfiles.save_image(tmp_path / "f", data)
    image = idfiles.open_image(tmp_path / "f")
    assert image.doc_ids == [None, -3, 2, 9, 10] and image.counts.tolist() == counts.tolist()
    assert (image.ids() == ids).all() and (image.ids(70, 200) == ids[70:200]).all() and len(image.ids(5, 5)) == 0
    with pytest.raises(ValueError):
        idfiles.Image(b"something else than an image")


def test_files_hold_all_documents_in_order(table, encoder):
    rows = [*ODD, (100, "the end"), (-5, "first")]
    images = idfiles.write_id_files(table(rows))
    got = [tuple(r) for r in idfiles.document_digests(images).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for d, t in order:
        ids = [*plain(encoder, t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want
    back = {(r["doc_id"], r["start"]): r["ids"] for r in idfiles.read_id_files(images).collect()}
    assert [back[d, s] for d, s, _, _ in want] == [[*plain(encoder, t), 2] for _, t in order]


def test_empty_tables(table):
    assert idfiles.document_digests(idfiles.write_id_files(table([]))).count() == 0
    assert packing.packing_digest(table([])).count() == 0


def check_packing(rows, sizes, capacity):
    """Each piece once and as cut; sequences filled without gaps."""
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, n in sizes.items():
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["length"] for r in pieces[1:]] == [capacity] * (len(pieces) - 1) and 0 < pieces[0]["length"] <= capacity
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == n
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def best_fit_decreasing(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= x]
        if fits:
            room[room.index(min(fits))] -= x
        else:
            room.append(capacity - x)
    return len(room)


def test_pack_documents(table, encoder):
    random.seed(3)
    rows = [(k, " ".join(random.choice(["one", "two", "three", "zebra"]) for _ in range(random.choice([3, 60, 90, 300, 5])))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 3000)]
    out = packing.pack_documents(table(rows).repartition(3), capacity=128).collect()
    ids = {k: [*plain(encoder, t), 0] for k, t in rows}
    n = check_packing(out, {k: len(v) for k, v in ids.items()}, 128)
    assert n <= best_fit_decreasing([r["length"] for r in out], 128)
    for r in out:
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]


def test_repeated_and_null_ids_are_packed(table):
    out = packing.packing_digest(table(ODD)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((d is None, d or 0) for d, _ in ODD)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=30))
def test_plans_hold_every_length_once(counts):
    found = packing.plan(counts, 64, groups=8)
    used = {}
    for m, lengths in found:
        assert m > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] = used.get(x, 0) + m
    assert used == counts
    table = packing.places(found, 64)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = packing.place_of(table, length, rank)
    assert len(set(zip(sequence.tolist(), offset.tolist()))) == len(length)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.minimum(2048, np.exp(rng.normal(6, 1, 20_000)).astype(int) + 1)
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist()))
    assert sum(m for m, _ in packing.plan(counts)) <= 1.01 * -(-int(lengths.sum()) // 2048)
