import re
from collections import Counter

from tallygrove.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(hit),
    )


CASES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b c a b c"), (4, "a b c a b c"), (None, "x " * 60),
    (5, "a\nb\na\n\n\na "), (6, "é<b>|ü #1 z q"), (7, "word " * 30_000), (8, "a b c d a b c e"),
]


def test_measures_match_brute_force(docs):
    rows = quality.measure(docs(*CASES)).collect()
    got = Counter((r["doc_id"], *[r[c] for c in quality.MEASURES]) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in CASES)


def test_policies_share_one_ledger(docs):
    stored = quality.ledger(docs((1, "w " * 10), (2, " ".join(f"a{i}" for i in range(60))), (3, "# " * 60)))
    bits = {r["doc_id"]: r["fail_bits"] for r in stored.collect()}
    assert bits == {1: 0b001011, 2: 0, 3: 0b001110}
    base = {r["doc_id"]: r["kept"] for r in quality.apply_policy(stored, quality.BASE).collect()}
    assert base == {1: False, 2: True, 3: False}
    table = {r["rule"]: r for r in quality.ablation(stored, quality.Policy("w", ("few_words", "symbols"))).collect()}
    assert table["few_words"]["n_failed"] == table["few_words"]["n_failed_alone"] == 1
    assert table["symbols"]["n_kept"] == 1 and table["symbols"]["n_kept_without"] == 2


def test_empty_table(docs, spark):
    empty = docs().filter("false")
    assert quality.ledger(empty).count() == 0
    assert quality.ablation(quality.ledger(empty), quality.V1).count() == 0


def test_main_path_is_native(documents):
    plan = quality.ledger(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_more_measures(docs):
    text = "- a 1\n  * b 22...\n• c …\nplain -\n\n" + "w " * 3
    (r,) = quality.measure(docs((1, text))).collect()
    assert [r[c] for c in quality.MORE_MEASURES] == [11, 3, 3, 2]
    (r,) = quality.measure(docs((1, None))).collect()
    assert [r[c] for c in quality.MORE_MEASURES] == [0, 0, 0, 0]


def test_policies_read_the_stored_ledger_alone(docs, spark):
    """A policy of a later version and its ablation need no look at the texts."""
    rows = docs((1, "w " * 100), (2, " ".join(f"ab{chr(97 + i % 26)}c{chr(97 + i // 26)}" for i in range(60))), (3, None), (4, "9 " * 70))
    stored = quality.store(rows, quality.EXTENDED)
    assert all("quality-ledger" in f for f in stored.inputFiles())
    assert {r["doc_id"]: r["fail_bits"] for r in stored.collect()} == {1: 0b1001010, 2: 0, 3: 1, 4: 0b11001010}
    judged = quality.apply_policy(stored, quality.V2, quality.EXTENDED)
    assert judged.inputFiles() == stored.inputFiles()
    assert {r["doc_id"] for r in judged.collect() if r["kept"]} == {2}
    table = {r["rule"]: tuple(r)[1:] for r in quality.ablation(stored, quality.V2, quality.EXTENDED).collect()}
    assert len(table) == 8 and table["few_words"] == (1, 1, 1, 2) and table["digits"] == (1, 0, 1, 1)
