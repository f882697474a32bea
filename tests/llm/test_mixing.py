import pytest

from proselake.llm import bpe, mixing

ROWS = [(i, f"the harbour of the north holds {i} grey ships " * 4, "en", "sea") for i in range(60)] + [(100 + i, f"a green meadow above the village grows {i} kinds of corn " * 4, "en", "land") for i in range(20)] + [(200, "the grey harbour holds ships", "en", None), (201, None, "en", "sea"), (202, "", None, None)]
TARGETS = [("sea", 0.5, 2), ("land", 0.3, 4), ("rare", 0.2, 3), (None, 0.1, 1)]


@pytest.fixture(scope="module")
def mix(docs_of, spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return mixing.Mixture(docs_of(ROWS), targets), docs_of(ROWS), targets


def test_short_sources(mix, spark):
    _, docs, targets = mix
    enc = bpe.Encoder.of(bpe.VOCABULARY)
    own = {}
    for _, t, _, s in ROWS:
        own[s] = own.get(s, 0) + len(enc.encode(t))
    total = sum(n for s, n in own.items() if s is not None)
    want = sorted(s for s, share, cap in TARGETS if s and share * total > cap * own.get(s, 0))
    assert sorted(r.source for r in mixing.short_sources(docs, targets).collect()) == want == ["rare"]


def test_rates_and_draw(mix):
    m, _, _ = mix
    rates = {r.doc_id: r.rate for r in m.rates().collect()}
    assert rates[0] == pytest.approx(rates[1]) and 0 < rates[0] <= 2 and all(0 <= r <= 4 for r in rates.values())
    copies = {r.doc_id: r.copies for r in m.draw().collect()}
    assert copies == {r.doc_id: r.copies for r in m.draw().collect()} and max(copies.values()) <= 4
    rep = {r.source: r for r in m.report().collect()}
    assert rep["rare"].actual_share == 0 and rep["sea"].most_copies <= 2
    assert abs(rep["sea"].actual_share + rep["land"].actual_share - 1) < 1e-9


def test_every_document_has_posteriors(mix):
    m, docs, _ = mix
    rows = m.members.collect()
    assert len(rows) == docs.count() and all(sum(r.q) == mixing.PARTS for r in rows)
    row = next(r for r in rows if r.doc_id == 200)
    assert row.k == -1 and m.domains[row.at[max(range(len(row.q)), key=lambda i: row.q[i])]] == "sea"


def test_fit_is_the_least_squares_optimum(mix):
    """At the end no rate can move within its bounds and bring the expected tokens nearer."""
    m, _, _ = mix
    left = (m.target - m.expected) / m.total
    d = {x: i for i, x in enumerate(m.domains)}
    assert abs(left[d["sea"]]) < 1e-3 and abs(left[d["land"]]) < 1e-3 and left[d["rare"]] == pytest.approx(0.2)


def test_memberships_move_the_fit(docs_of, spark):
    """Texts of a source that read like another's fill that one's target, so that its own documents are drawn less."""
    rows = ROWS[:80] + [(300 + i, f"the harbour of the north holds {i} grey ships " * 4, "en", "land") for i in range(40)]
    targets = spark.createDataFrame([("sea", 0.6, 3), ("land", 0.4, 3)], "source string, target_share double, max_repeats int")
    rate = {t: next(r.rate for r in mixing.Mixture(docs_of(rows), targets, trust=t).rates().collect() if r.doc_id == 0) for t in (1.0, 0.5)}
    assert rate[0.5] < 0.95 * rate[1.0]


def test_no_targets(docs_of, spark):
    empty = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.short_sources(docs_of(ROWS[:3]), empty).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixing.short_sources(none, targets).count() == 0


def test_documents_between_domains(docs_of, spark, monkeypatch):
    """What they fill of one domain they overfill of the other, so that its own documents' rate falls; the report counts all that is drawn."""
    sea, land = "the harbour of the north holds grey ships ", "a green meadow above the village grows corn "
    rows = [(i, sea * 4, "en", "sea") for i in range(40)] + [(100 + i, land * 4, "en", "land") for i in range(8)] + [(200 + i, (sea + land) * 2, "en", None) for i in range(10)]
    monkeypatch.setattr(mixing, "SHARPNESS", 0.0)  # memberships are the prior
    targets = spark.createDataFrame([("sea", 0.5, 2), ("land", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs_of(rows), targets)
    at = m.domains.index("sea")
    assert abs(m.target[at] - m.expected[at]) < 0.01 * m.total and m.fitted[at] < 0.95 * m.target[at]
    member = {r.doc_id: r for r in m.members.collect()}
    used = {d: 0.0 for d in m.domains}
    for r in m.draw().collect():
        assert r.copies <= 2
        if r.source:
            used[r.source] += r.tokens * r.copies
        else:
            for i, q in zip(member[r.doc_id].at, member[r.doc_id].q):
                used[m.domains[i]] += r.tokens * r.copies * q / mixing.PARTS
    rep = {r.source: r for r in m.report().collect()}
    assert sum(r.soft_tokens for r in rep.values()) > 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert {d: r.actual_share for d, r in rep.items()} == pytest.approx({d: v / sum(used.values()) for d, v in used.items()}, rel=1e-5)
