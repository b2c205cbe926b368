import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from structsim.llm import packing, token_counts, token_files
from structsim.llm.tokens import default_tokenizer, encoded_slices, encoder

ODD = ["", "  ", " a", "a ", "a  b", "a   b", "\n a\n  b", "it's  we'll 12²3 ½ <|endoftext|>", "日本 語  ", "tab\t x \n y \n\n  z  ", "😀 a😀b", " \n", "a \n", "a\n b", "x \n y", "ok\xa0 z", "a\x1c b"]


def plain(text):
    return encoder(default_tokenizer()).plain(text or "").tolist()


def encoded(texts):
    out = []
    for _, _, ids, ends in encoded_slices(pa.record_batch([pa.array(texts, pa.string())], names=["t"]), 0, default_tokenizer(), None):
        out += [part.tolist() for part in np.split(ids, ends[:-1])]
    return out


def test_ids_are_the_tokenizers():
    texts = [*ODD, None, *ODD[::-1]]
    assert encoded(texts) == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'st .,\n\t 1²é語 ")), max_size=25), max_size=6))
def test_ids_are_the_tokenizers_for_any_text(texts):
    assert encoded(texts) == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    file = token_files.TokenFile(token_files.pack_file([1], np.array([len(ids)]), ids))
    assert file.ids().tolist() == ids.tolist()
    for k in range(0, len(ids), 37):
        assert file[k] == ids[k]


@pytest.mark.parametrize("file_tokens", [40, 1_000_000])
def test_files_read_back(table, odd_rows, spark, file_tokens):
    from structsim.llm.workspace import new_folder

    files = token_files.write_token_files(table(odd_rows), new_folder(spark, "t"), file_tokens=file_tokens)
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want, flat = 0, [], []
    for d, text in rows:
        ids = np.array([*plain(text), 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
        flat += ids.tolist()
    key = lambda r: (r[1], r[2])
    assert sorted((tuple(r) for r in token_files.document_digests(files).collect()), key=key) == sorted(want, key=key)
    places = random.Random(1).sample(range(at), 50)
    asked = spark.createDataFrame([(p,) for p in [*places, at + 5]], "position long")
    assert {r["position"]: r["id"] for r in token_files.token_at(files, asked).collect()} == {p: flat[p] for p in places}


def test_empty_table_has_no_files(table):
    assert token_files.token_digests(table([])).count() == 0
    assert packing.pack_documents(table([])).count() == 0
    assert token_counts.count_tokens(table([])).count() == 0


def test_packing(table, odd_rows, prose):
    rows = [*odd_rows, *((100 + k, " ".join(prose(random.Random(k).randint(1, 500), k))) for k in range(200))]
    packed = packing.pack_documents(table(rows), with_ids=True)
    got = packed.toPandas()
    assert got.length.max() <= 1024 and (got.groupby("sequence_id").length.sum() <= 1024).all()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    for d, text in rows:
        if d is not None and d != 6:
            ids = [*plain(text), 2]
            mine = got[got.doc_id == d].sort_values("piece")
            assert mine.piece.tolist() == list(range(-(-len(ids) // 1024)))
            assert [i for part in mine.ids for i in np.frombuffer(part, "<u4")] == ids
            assert (mine.length[1:] == 1024).all() and mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist()
    assert (got.doc_id == 6).sum() == 2 and got.doc_id.isna().sum() == 1
    assert got.sequence_id.nunique() <= 1.15 * got.length.sum() / 1024 + 2
    whole = packing.sequences(packed).collect()
    assert sum(r["length"] for r in whole) == got.length.sum() and all(len(r["ids"]) == 4 * r["length"] for r in whole)


def test_sum_of_squares_takes_the_least_growth():
    """Against the definition: each placement makes the sum of squared counts per gap as small as any could."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30, 200)
    sequence, offset = packing.sum_of_squares(lengths, 30)
    fill: dict[int, int] = {}
    for p, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        def squares(state):
            gaps = [30 - f for f in state.values() if f < 30]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        choices = [squares({**fill, k: f + p}) for k, f in fill.items() if f + p <= 30] + [squares({**fill, -1: p})]
        assert fill.get(s, 0) == o
        fill[s] = o + p
        assert squares(fill) == min(choices)


def naive(raw, pieces, longest):
    k = n = 0
    while k < len(raw):
        k += next((w for w in range(min(longest, len(raw) - k), 0, -1) if raw[k : k + w] in pieces), 1)
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=9), st.binary(max_size=16).map(lambda b: bytes(97 + x % 4 for x in b)))
def test_automaton_is_greedy(pieces, raw):
    assert token_counts.Automaton(pieces).count(raw) == naive(raw, pieces, 5)


def test_counts_of_texts(table, odd_rows):
    import re

    pieces = set(token_counts.byte_pieces(default_tokenizer()))
    longest = max(map(len, pieces))
    want = sorted((str(d), len((t or "").encode()), sum(naive(p.encode(), pieces, longest) for p in re.split("(?= )", t or ""))) for d, t in odd_rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(table(odd_rows)).collect()) == want


NBSP = ["a \xa0 \xa0 \xa0b", "\xa0 \xa0 \xa0", " \xa0 \xa0", "x\u3000 \u2003y", "x\u2003 \xa0 \u3000 z", "a\n \n b", "a \xa0 b \xa0 c", "x <|endoftext|> y", "a \n<|endoftext|>\n b", "<|endoftext|>"]


def fresh(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids


def test_ids_are_a_fresh_tokenizers():
    assert fresh(NBSP[0]) == [64, 11504, 220, 1849, 65] and fresh("<|endoftext|>") == [50256]
    texts = [*ODD, *NBSP, *(f"{t} {u}" for t in NBSP for u in NBSP)]
    assert encoded(texts) == [fresh(t) for t in texts]
    assert [encoded([t])[0] for t in texts if t] == [fresh(t) for t in texts if t]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'. \n\t", "\xa0", " \xa0", "\x85", "\u2003", "\u3000", "\u180e", "\u201c", "<|endoftext|>"]), max_size=14).map("".join), max_size=6))
def test_ids_are_the_tokenizers_for_any_whitespace(texts):
    assert encoded(texts) == [plain(t) for t in texts]


def test_counts_keep_pieces_with_inner_blanks(table):
    pieces = set(token_counts.byte_pieces(default_tokenizer()))
    longest = max(map(len, pieces))
    rows = list(enumerate([*NBSP, *ODD, " \xa0" * 9 + " b", "a" + " \xa0" * 3]))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(table(rows)).collect()}
    assert got == {k: naive(t.encode(), pieces, longest) for k, t in rows}
