import numpy as np

from proselake.llm import repetition as R


def brute_share(words, n):
    seen, covered = {}, set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            covered |= set(range(i, i + n))
        seen.setdefault(g, i)
    return len(covered) / max(1, len(words))


def test_shares_against_brute_force():
    rng = np.random.default_rng(3)
    texts, want = [], []
    for _ in range(60):
        w = [f"w{k}" for k in rng.integers(0, 40, rng.integers(1, 120))]
        for _ in range(rng.integers(0, 4)):
            a = rng.integers(0, len(w))
            w += w[a : a + 20]
        texts.append(" ".join(w))
        want.append((brute_share(w, 8), brute_share(w, 4)))
    got = R.measure([*texts, None, "", "   ", "!!!"])
    assert np.allclose(got[: len(want), :2], want) and not got[len(want) :].any()


def test_unspaced_scripts_count_letters():
    s = "没有果园南湾显得很安静秦鸣为什么藏起渔网林川"
    assert R.measure([s + "。" + s])[0, 0] == 0.5
    assert R.measure([s])[0, 0] == 0


def test_case_and_punctuation_are_ignored():
    a = "The red dog went to the old mill at noon"
    assert R.measure([f"{a}. {a.upper()}!"])[0, 0] == 0.5


def test_outliers(docs_of):
    clean = lambda i: " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(80))
    rows = [(i, clean(i), "en", "a") for i in range(60)]
    rows += [(200 + i, " ".join(["a stitch in time saves nine they say"] * 12), "en", "a") for i in range(5)]
    rows += [(300, None, None, None), (301, "", "en", "a"), (200, rows[60][1], "en", "a")]
    got = sorted(r.doc_id for r in R.repetitive(docs_of(rows)).collect())
    assert got == [200, 201, 202, 203, 204]


def test_most_rows_repetitive(docs_of):
    """A group in which every text repeats itself is still held against the corpus."""
    clean = lambda i: " ".join(f"w{(i * 31 + k * k) % 991}" for k in range(60))
    rows = [(i, clean(i), "en", "a") for i in range(100)] + [(500 + i, " ".join([f"spam {i} again and again we say so"] * 10), "fr", "b") for i in range(40)]
    got = {r.doc_id for r in R.repetitive(docs_of(rows)).collect()}
    assert got == {500 + i for i in range(40)}


def test_empty(spark):
    assert R.repetitive(spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")).count() == 0


def test_corpus_of_repetition(docs_of):
    """Where nearly every text repeats itself, the estimates' centres are there, and still none of these texts passes."""
    rows = [(i, " ".join([f"spam {i} again and again we say so {'x' * (i % 7)}"] * (4 + i % 9)), "en", "a") for i in range(120)] + [(900, "one short clean text of its own", "en", "a")]
    rows += [(1000 + i, " ".join([f"a tiny group number {i} says the same thing over"] * 5), "xx", f"s{i}") for i in range(3)]
    share = {r.doc_id: r.share for r in R.repetition(docs_of(rows)).collect()}
    assert {r.doc_id for r in R.repetitive(docs_of(rows)).collect()} == {i for i, s in share.items() if s >= 0.5} and sum(s >= 0.5 for s in share.values()) > 100


def test_estimates_reject_by_the_group(docs_of):
    """The same vector may be far from the centre of a narrow group and near that of a wide one."""
    clean = lambda i, n: [f"v{(i * 37 + k * k) % 997}" for k in range(n)]
    some = lambda i, n: " ".join(clean(i, 100) + clean(i, n))
    rows = [(i, some(i, 0), "en", "narrow") for i in range(200)] + [(1000 + i, some(i, (i * 7) % 60), "en", "wide") for i in range(200)]
    rows += [(5000, some(3, 25), "en", "narrow"), (5001, some(3, 25), "en", "wide")]
    got = {r.doc_id: r.outlier for r in R.repetition(docs_of(rows)).collect()}
    assert got[5000] and not got[5001]


def test_concentration_finds_the_clean_half(docs_of):
    """A third of far outliers doesn't move the centre."""
    clean = lambda i: " ".join(f"w{(i * 31 + k * k) % 991}" for k in range(60))
    rows = [(i, clean(i), "en", "a") for i in range(100)] + [(500 + i, " ".join([f"spam {i} again and again we say so"] * 10), "en", "a") for i in range(50)]
    est = {r.grp: r for r in R.robust_estimates(R.repetition_statistics(docs_of(rows))).collect()}
    assert est["en|a"].m0 < 0.01 and est["en|a"].n == 150
