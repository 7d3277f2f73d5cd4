import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajloom.llm import pii
from trajloom.llm.bilstm import Tagger

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def plain(text):
    """The patterns as the contract has them."""
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@-+_%1249 ()0\n١é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_known_spans():
    t = "Mail a.b+c@x-y.example.org, ip 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111, phone +1 (504) 555-2652."
    assert [t[a:b] for a, b, _ in pii.base_spans(t)] == ["a.b+c@x-y.example.org", "10.0.0.255", "4111 1111 1111 1111", "+1 (504) 555-2652"]
    assert pii.base_spans("9" * 6000 + "." + "1.1.1") == []
    assert pii.base_spans("a" * 100_000 + "@" * 100_000) == []


def test_gradients_are_those_of_the_loss():
    model = Tagger(3, embed=3, hidden=2, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, 20, (3, 6)), rng.integers(0, 3, (3, 6))
    _, g = model.gradients(ids, tags)
    for name in model.p:
        for at in [np.unravel_index(i, model.p[name].shape) for i in rng.choice(model.p[name].size, min(4, model.p[name].size), replace=False)]:
            kept = model.p[name][at]
            losses = []
            for e in (1e-3, -1e-3):
                model.p[name][at] = kept + e
                losses.append(model.gradients(ids, tags)[0])
            model.p[name][at] = kept
            assert abs((losses[0] - losses[1]) / 2e-3 - g[name][at]) < 2e-2 * max(1.0, abs(g[name][at])), name


def test_viterbi_by_brute_force():
    import itertools

    model = Tagger(3, embed=3, hidden=2, seed=4)
    model.p["A"] = np.random.default_rng(3).standard_normal((3, 3)).astype(np.float32)
    ids = np.random.default_rng(2).integers(0, 30, (4, 5))
    s, (rows, some, _) = model.emissions(ids), model.decode(ids)
    assert np.allclose(model.scores(ids).transpose(0, 2, 1), s, atol=1e-5)
    tags = np.zeros((4, 5), np.int64)
    tags[rows] = some
    for w in range(4):
        score = lambda y: sum(s[t, w, y[t]] for t in range(5)) + sum(model.p["A"][a, b] for a, b in zip((0, *y), (*y, 0), strict=True))  # noqa: B023, E731
        assert abs(score(tags[w]) - max(map(score, itertools.product(range(3), repeat=5)))) < 1e-4


def test_held_out_accuracy(tagger):
    """On whole texts of the kind it is trained on, by the model alone."""
    import random

    rng = random.Random(4242)
    made = [pii.invented(rng) for _ in range(600)]
    have = [set(x) for x in pii.tagged([t for t, _ in made], tagger)]
    hits = sum(len(a & set(b)) for a, (_, b) in zip(have, made, strict=True))
    print(f"invented {sum(len(b) for _, b in made)}, found {sum(map(len, have))}, right {hits}")
    assert hits >= 0.9 * sum(len(b) for _, b in made) and hits >= 0.9 * sum(map(len, have))


def test_added_spans(tagger):
    t = "x " * 200 + "Call (504) 555-2652 now, or write to joe.x (at) mail (dot) com today. token = \"0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d\" on 2024-05-12."
    (base, every), (none, nothing) = pii.all_spans([t, "no such thing here"], tagger)
    assert base == [] and [t[a:b] for a, b, _ in every] == ["(504) 555-2652", "joe.x (at) mail (dot) com"]
    assert none == nothing == []


def test_stretches_decode_as_whole_windows_do(tagger):
    ids, _ = pii.labelled(200, 88, 77)
    s, a = tagger.scores(ids).transpose(0, 2, 1), tagger.p["A"]
    rows, some, _ = tagger.decode(ids)
    tags = np.zeros(ids.shape, np.int64)
    tags[rows] = some
    best = s[0] + a[0]
    for t in range(1, len(s)):
        best = s[t] + (best[:, :, None] + a[None]).max(1)
    own = np.take_along_axis(s, tags.T[:, :, None], 2)[:, :, 0].sum(0) + a[0, tags[:, 0]] + a[tags[:, :-1], tags[:, 1:]].sum(1) + a[tags[:, -1], 0]
    assert np.allclose((best + a[:, 0]).max(1), own, atol=1e-2)


def test_windows_cover_whole_texts():
    for n in (0, 1, pii.WINDOW, pii.WINDOW + 1, 5000):
        w = pii.windows_of(n)
        assert not w if n == 0 else w[0][0] == 0 and w[-1][1] == n
        assert all(b - a <= pii.WINDOW for a, b in w) and all(x[1] - y[0] == pii.OVERLAP for x, y in zip(w, w[1:], strict=False))


def test_spans_longer_than_windows_are_joined():
    n, k = 3 * pii.WINDOW, 1 + 2 * pii.KINDS.index("phone")
    tags = np.zeros(n, np.int64)
    tags[100] = k
    tags[101:900] = k + 1
    decoded = {(a, b): (tags[a:b], np.ones(b - a)) for a, b in pii.windows_of(n)}
    assert pii.reconciled(pii.candidates(n, decoded)) == [(100, 900, "phone")]
    assert pii.reconciled([(0, 5, "ip", 1.0), (3, 9, "card", 2.5), (8, 12, "ip", 1.0), (0, 5, "ip", 3.0)]) == [(0, 5, "ip"), (8, 12, "ip")]


#: Written by hand, not by invented().
DISGUISED = (
    "joe at mail dot com", "maria.lopez [at] correo [dot] es", "h.schmidt (at) web (dot) de", "jean-luc AT poste DOT fr", "support(at)acme-tools.org", "a_very_long_mailbox_name_of_more_than_forty_characters at example dot com",
    "(415) 555-0134", "020-7946-0958 11", "555.867.5309", "0049 30 901820", "415-555-0199", "4111.1111.1111.1111", "5500/0000/0000/0004", "10[.]0[.]13[.]7", "192 . 168 . 0 . 12", "172(dot)16(dot)254(dot)1",
)


def planted(texts):
    """Each text with a disguised item between two of its words: (text, start, end)."""
    out = []
    for i, t in enumerate(texts):
        words = t.split(" ")
        at = len(" ".join(words[: len(words) // 2]))
        item = DISGUISED[i % len(DISGUISED)]
        out.append((f"{t[:at]} {item} {t[at:].lstrip()}", at + 1, at + 1 + len(item)))
    return out


def test_recall_and_precision_on_documents(spark, tagger):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"] and 200 < len(r["text"]) < 20_000][:160]
    before, found, spurious, hits = pii.all_spans(docs, tagger), 0, 0, planted(docs)
    after = pii.all_spans([t for t, _, _ in hits], tagger)
    for (_, a, b), (_, every) in zip(hits, after, strict=True):
        found += any(x < b and y > a and min(y, b) - max(x, a) >= 0.7 * (b - a) for x, y, _ in every)
    spurious = sum(len(every) - len(own) for own, every in before)
    print(f"planted {len(hits)}, found {found}, added without planting {spurious}")
    assert found >= 0.9 * len(hits) and spurious <= 0.1 * len(hits)
    assert pii.reconciled([(0, 5, "ip", 1.0), (3, 9, "card", 2.5), (8, 12, "ip", 1.0), (0, 5, "ip", 3.0)]) == [(0, 5, "ip"), (8, 12, "ip")]


def test_query_columns(spark, docs, empty, tagger):
    extra = spark.createDataFrame([(50, "a@b.co and a@b.co", "s", 3), (51, "1.2.3.4", None, None)], docs.schema)
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs.unionByName(extra), tagger=tagger).collect()}
    assert rows[50]["spans"] == "email:0:6,email:11:17" and rows[50]["n_email"] == 2
    assert rows[50]["base_sha256"] == hashlib.sha256(b"email:0:6,email:11:17").hexdigest()
    assert rows[51]["n_ip"] == 1 and rows[0]["spans"] == "" and rows[0]["n_card"] == 0
    assert pii.find_personal_data(empty, tagger=tagger).count() == 0
