import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablewright.llm import packing, token_files, tokens

TEXTS = ["", None, "Hello, world! it's 3rd_place  \n\n x", "naïve café – “quotes” 日本語 \u00a0\u2028x", "tabs\t\tand\r\nlines ", " leading", "a" * 5000, "it's we'll I'D don't", "x²Ⅷ٣", "\x1c\x1d control", "<|endoftext|> here", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "éÉ ß ÷ × ¼"]


@pytest.fixture(scope="module")
def encode():
    return tokens.Encoder(tokens.tokenizer_path())


LIBRARY = Tokenizer.from_file(tokens.tokenizer_path())


def whole(text):
    """Ids by the library as it comes."""
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(encode):
    rng = random.Random(1)
    alphabet = "ab  zÉé'’stdm09_-.,\n\t!日"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    for text, ids in zip(texts, encode.encode_some(texts)):
        assert ids.tolist() == whole(text)
    assert encode.encode("again it's").tolist() == whole("again it's")


def test_a_cleared_memo_changes_nothing(encode, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 3)
    for _ in range(3):
        assert [x.tolist() for x in encode.encode_some(TEXTS)] == [whole(t) for t in TEXTS]


def test_files_round_trip(spark, encode, monkeypatch):
    rng = random.Random(2)
    docs = [(i * 3 % 101, " ".join(rng.choice(["word", "naïve", "日本", "x1"]) for _ in range(rng.randrange(400)))) for i in range(101)] + [(200, None), (201, ""), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    folder, index = token_files.write_tokens(df, sequence=64)
    rows = token_files.read_tokens(folder, index).collect()
    expected, at = {}, 0
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array(whole(text) + [tokens.END_ID], dtype="<u4")
        expected[doc] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected


def test_sequences_have_equal_length(tmp_path):
    path = tmp_path / "x.arrow"
    with pa.OSFile(str(path), "wb") as sink:
        out = token_files.FileWriter(sink, np.uint16, 8)
        places = [out.add(np.arange(n, dtype=np.uint32)) for n in (3, 0, 10, 5000, 1)]
        out.close()
    assert places == [0, 3, 3, 13, 5013]
    reader = token_files.FileReader(f"file://{path}")
    assert reader.ids(13, 5000).tolist() == list(range(5000)) and reader.ids(3, 0).tolist() == []
    table = pa.ipc.open_file(pa.memory_map(str(path))).read_all()
    masks = table.column("mask").to_pylist()
    assert sum(map(sum, masks)) == 5014 and all(len(m) == 8 for m in masks) and all(all(m) for m in masks[:-1])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.digest(empty).count() == 0 and packing.pack_documents(empty).count() == 0


def fill(rows, most=packing.SEQUENCE):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= most
    return len(sequences)


def test_packing(spark, encode):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["one", "two", "three", "naïve"]) for _ in range(rng.choice([0, 3, 40, 300, 700, 1500, 2600])))) for i in range(300)] + [(5, "copy"), (5, "copy"), (None, None)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert fill(rows) <= best_fit_decreasing([r["length"] for r in rows], packing.SEQUENCE) * 1.02 + 1
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in docs[:300]:
        if doc == 5:
            continue
        ids = np.array(whole(text) + [tokens.END_ID], dtype="<u4")
        parts = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == packing.SEQUENCE for r in parts[1:])
        for r in parts:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def best_fit_decreasing(sizes, most):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits)[1]] -= s
        else:
            gaps.append(most - s)
    return len(gaps)


def placed(sizes, most):
    """What the rounds of one task make of pieces of these sizes, checked; the number of sequences."""
    sequences = {}
    for i, sequence, offset in packing.rest([packing.PIECE] * len(sizes), sizes, list(range(len(sizes))), most):
        sequences.setdefault(sequence, []).append((offset, i))
    assert sorted(i for x in sequences.values() for _, i in x) == list(range(len(sizes)))
    for found in sequences.values():
        end = 0
        for offset, i in sorted(found):
            assert offset == end
            end += sizes[i]
        assert end <= most
    return len(sequences)


def test_rounds_are_about_as_good_as_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [min(100, max(1, int(rng.expovariate(1 / rng.choice([5, 30, 60]))))) for _ in range(rng.randrange(1, 400))]
        assert placed(sizes, 100) <= best_fit_decreasing(sizes, 100) * 1.05 + 1
    assert placed([], 100) == 0 and placed([7] * 1000, 100) == 72


def test_matches_across_partitions_are_those_of_one_stack():
    rng = random.Random(6)
    for _ in range(200):
        rows = sorted(((-rng.randrange(1, 30), rng.randrange(2), i) for i in range(rng.randrange(60))))
        kinds, sizes, ids = [k for _, k, _ in rows], [-s for s, _, _ in rows], [i for _, _, i in rows]
        whole_run = {i: gap_id for _, i, _, _, gap_id in packing.Sweep().take(kinds, sizes, ids)}
        edges = sorted(rng.randrange(len(rows) + 1) for _ in range(4))
        found, left_pieces, left_gaps = {}, [], []
        for a, b in zip([0, *edges], [*edges, len(rows)]):
            one, waits = packing.Sweep(), []
            for _, i, place, _, gap_id in one.take(kinds[a:b], sizes[a:b], ids[a:b]):
                found[i] = gap_id
                if place is not None:
                    waits.append(i)
            left_pieces.append(waits)
            left_gaps.append([i for _, i in one.stack])
        number = {packing.PIECE: {}, packing.GAP: {}}
        for p, kind, first, last, shift in packing.stretches([len(x) for x in left_pieces], [len(x) for x in left_gaps]):
            for place in range(first, last + 1):
                m = shift + place if kind == packing.PIECE else shift - place
                assert m not in number[kind]
                number[kind][m] = (left_pieces if kind == packing.PIECE else left_gaps)[p][place]
        found.update({i: number[packing.GAP][m] for m, i in number[packing.PIECE].items()})
        assert found == whole_run and number[packing.PIECE].keys() == number[packing.GAP].keys()


def test_distributed_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "LAST", 60)
    rng = random.Random(5)
    sizes = [rng.choice([1, 7, 7, 7, 30, 45, 50, 51, 60, 99, 100]) for _ in range(900)]
    found = spark.createDataFrame([(i, None if i % 50 == 0 else 2**60 + i, 0, 0, s, i) for i, s in enumerate(sizes)], "id long, doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(found, 100).collect()
    assert sorted((r["doc_id"], r["ids_crc32"], r["length"]) for r in rows if r["doc_id"]) == [(2**60 + i, i, s) for i, s in enumerate(sizes) if i % 50]
    assert len(rows) == 900 and fill(rows, 100) <= best_fit_decreasing(sizes, 100) * 1.03 + 1


def test_ids_beside_nulls_stay_exact(spark):
    docs = [(2**60 + 1, "a"), (2**60 + 3, "b"), (None, "c")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, id long, length int").coalesce(1)
    assert {r["doc_id"] for r in packing.pack_documents(df).collect()} == {d for d, _ in docs}
    assert {r["doc_id"] for r in token_files.digest(df).collect()} == {d for d, _ in docs}
