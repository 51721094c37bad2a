"""Personal data: base spans against the plain patterns, the tagger's gradients and accuracy, windows, and defined cases."""

import hashlib
from collections import Counter

import brute
import numpy as np
import pytest
from corvid.llm import personal, planted
from corvid.llm.tagger import Tagger

MODEL = personal.Model(windows=9000)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def tagger(spark, docs):
    return personal.fitted(spark, [d[:2000] for d in docs[:100]], MODEL)


def spans(tagger, texts, where=personal.places):
    found = personal.tagged(texts, tagger, MODEL, where)
    return [personal.reconciled(t, f, personal.base_spans(t)) for t, f in zip(texts, found, strict=True)]


ODD = [
    "a@b.c.d@e.f", "a@b.c@d.e", "..%@x.y-.z", "x@y", "1.2.3.4.5.6.7.8", "1.2.3.256", "0001.2.3.4", "a1.1.1.1b", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "79927398713 0000",
    "+1 (487) 555-7209 +49.30.123456", "+1234567890123456", "++1 2 3 4 5 6 7 8 9 0", "+1" + " " * 300 + "2", "café@ü.de", "é@é.com x@é.com", "@@a@b.cc@", "1" * 5000, "a" * 5000 + "@", "٣.٣.٣.٣", "12 34 56-78 90 12 34 5", "99999999999999999999999999.1.1.1",
]


def test_base_against_plain_patterns(docs):
    for text in ODD + docs:
        assert personal.base_spans(text) == brute.personal_base(text), text[:80]


def test_gradients():
    """Exact ones against differences, in double precision."""
    tag = Tagger(7, 3, 5, 1)
    tag.w = {k: v.astype(np.float64) for k, v in tag.w.items()}
    rng = np.random.default_rng(0)
    ids, gold = rng.integers(0, 7, (4, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 0, 0, 0, 0], [2, 2, 0, 1, 2, 2], [3, 4, 4, 1, 1, 0]])
    _, slope = tag.gradients(ids, gold)
    for name, g in slope.items():
        for at in [tuple(int(rng.integers(n)) for n in g.shape) for _ in range(6)]:
            if name == "step" and tag._rules()[0][at] < -1e3:
                continue
            old, eps, loss = tag.w[name][at], 1e-2, []
            for sign in (1, -1):
                tag.w[name][at] = old + sign * eps
                loss.append(tag.gradients(ids, gold)[0])
            tag.w[name][at] = old
            assert (loss[0] - loss[1]) / (2 * eps) == pytest.approx(float(g[at]), abs=2e-3, rel=2e-2), (name, at)


def test_viterbi_against_all_paths():
    import itertools

    tag = Tagger(6, 2, 5, 3)
    ids = np.random.default_rng(1).integers(0, 6, (5, 4))
    emit, (step, start) = tag._run(ids)[0], tag._rules()
    best, _ = tag.decode(ids)
    for e, path in zip(emit, best, strict=True):
        score = lambda p: start[p[0]] + sum(e[k, x] for k, x in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert score(tuple(path)) == pytest.approx(max(map(score, itertools.product(range(5), repeat=4))), abs=1e-4)


def test_held_out_accuracy(tagger, docs):
    """Made-up values of another seed, set in texts that the tagger has not seen; look-alikes and clean texts stay clean."""
    maker, clean = planted.Maker(99), [d for d in docs[100:] if not personal.base_spans(d) and len(d) > 200]
    texts, gold = [], []
    for i in range(400):
        c, kind = clean[i % len(clean)], planted.KINDS[i % 4]
        value, lead = getattr(maker, kind)(), maker.one(planted.LEADS[kind][2:])
        at = c.find(" ", len(c) // 2) + 1
        texts.append(f"{c[:at]}{lead}{value} {c[at:]}")
        gold.append((kind, at + len(lead), at + len(lead) + len(value)))
    hit, extra = Counter(), 0
    for (kind, a, b), got in zip(gold, spans(tagger, texts), strict=True):
        hit[kind] += any(k == kind and s < b and a < e for k, s, e in got)
        extra += sum(not (s < b and a < e) for _, s, e in got)
    assert all(hit[k] >= 80 for k in planted.KINDS), hit
    assert extra <= 4
    assert sum(map(len, spans(tagger, clean))) == 0
    flagged = 0
    for i in range(200):
        text = f"{clean[i % len(clean)][:300]} {maker.other()} {clean[i % len(clean)][300:600]}"
        flagged += len(spans(tagger, [text])[0]) > len(personal.base_spans(text))
    assert flagged <= 16


def test_windows_that_meet_no_place_hold_no_span(tagger, docs):
    """Decoding every window of a text gives the same spans as those that meet a place, as others give none that is sound."""
    texts = [d + " call me at (415) 555-0199 or jane [at] mail [dot] example [dot] org " + d for d in docs[:60]]
    assert spans(tagger, texts) == spans(tagger, texts, lambda t: [(0, len(t))])


def test_values_anywhere_in_a_long_text(tagger):
    """Whatever place of a window a value starts at, it is found once."""
    filler = "The committee met again in the spring and the minutes were sent to all members of the board. "
    for shift in range(0, 96, 7):
        text = filler * 3 + "x" * shift + " call (415) 555-0199 now. " + filler * 3
        got = spans(tagger, [text])[0]
        at = text.index("(415)")
        assert got == [("phone", at, at + 14)], (shift, got)


def test_reconciled():
    """Base spans stay, what touches one goes, and of overlapping candidates the greatest total is kept."""
    text = "mail a@b.cc or call (415) 555-0199 x"
    base = personal.base_spans(text)
    at = text.index("(415)")
    found = [("email", 5, 11, 9.0), ("phone", at, at + 9, 2.0), ("phone", at + 6, at + 14, 2.0), ("card", at, at + 14, 50.0)]
    assert personal.reconciled(text, found, base) == [("email", 5, 11), ("phone", at, at + 14)]


def test_query_columns_and_defined_cases(spark, tagger):
    """Nulls, empty and very long texts, repeated rows, clashing names, an empty table."""
    long_text = "nothing to see here " * 60_000 + "reach me at joe@x.org or 10.0.0.1, card 4111 1111 1111 1111. " + "1 2 3 " * 30_000
    texts = [None, "", long_text, long_text, "x@y.zz " * 500, "plain", "Γεια 🙂 a@b.cc", *ODD]
    rows = [(None if i == 5 else min(i, 40), t, "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    got = personal.scanned(docs, tagger, MODEL).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    want = Counter()
    for _, t, *_ in rows:
        b = brute.personal_base(t)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want[(*(sum(k == x for k, *_ in b) for x in planted.KINDS), hashlib.sha256(said.encode()).hexdigest())] += 1
    assert Counter((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        assert len([x for x in r.spans.split(",") if x]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert personal.scanned(spark.createDataFrame([], "doc_id long, text string"), tagger).count() == 0
    assert personal.carriers(spark.createDataFrame([], "doc_id long, text string")) == []
