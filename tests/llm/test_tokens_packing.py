import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trajloom.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("ab 1'\n\t.é<|endoftext|>"))), max_size=80))
def test_cutting_at_safe_boundaries_leaves_tokens_as_they_are(text):
    pieces = tokens.pieces_of(text, 5)
    assert "".join(pieces) == text
    assert sum((ids(p) for p in pieces), []) == ids(text)
    assert ENCODER.ids(text) == ids(text)


def test_encoder_has_the_library_s_ids():
    rng = random.Random(1)
    for code in [*range(0x300), *(rng.randrange(0x110000) for _ in range(3000))]:
        if not 0xD800 <= code < 0xE000:
            t = f"a{chr(code)}b {chr(code)} 1{chr(code)}{chr(code)}"
            assert ENCODER.ids(t) == ids(t), hex(code)
    for t in ("a<|endoftext|>b  <|endoftext|>", " " * 4000 + "x", "\n\n \t x's 'LL", "ab" * 9000):
        assert ENCODER.ids(t) == ids(t)


def test_token_counts(docs, empty):
    got = tokens.with_token_counts(docs.withColumnRenamed("n_chars", "n_tokens"), PATH, limit=100).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(ids(t)), len(ids(t)) > 100)
    assert tokens.with_token_counts(empty, PATH).count() == 0


def test_sentencepiece_counts(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in tokens.with_token_counts(docs, path).collect():
        assert r["n_tokens"] == len(model.encode(r["text"] or ""))


def test_packing_places_every_piece_once(docs, empty):
    most = 64
    got = packing.pack(docs, PATH, most=most, group_docs=5).toPandas()
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = []
    for k, t in texts:
        x = np.array([*ids(t), 2], "<u4")
        want += [(k, i, s, n, zlib.crc32(x[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cuts(len(x), most))]
        assert sum(n for _, n in packing.cuts(len(x), most)) == len(x)
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert g["length"].sum() <= most
    assert packing.pack(empty, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=120))
def test_sum_of_squares_places_by_brute_force(lengths):
    """Each placement makes the sum of squared counts of gaps as small as any other place would."""
    bins, offsets = packing.sum_of_squares(np.array(lengths), 32)
    fill: dict[int, int] = {}

    def squares(f):
        gaps = [32 - x for x in f.values() if x < 32]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        options = [squares(fill | {k: x + n}) for k, x in fill.items() if x + n <= 32] + [squares(fill | {-1: n})]
        assert fill.get(b, 0) == o
        fill[b] = o + n
        assert squares(fill) == min(options)
    bins, _ = packing.packed(np.sort(np.array(lengths))[::-1], 32)
    assert all(np.bincount(np.unique(bins, return_inverse=True)[1], np.sort(np.array(lengths))[::-1]) <= 32)
