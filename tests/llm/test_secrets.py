from tallygrove.llm import secret_scan as ss
from tallygrove.llm.common import scratch
from pyspark.sql import functions as F

KEY = "AKIA" + "ABCDEFGH12345678"
CASES = {
    1: ("Password: 'hunter22' x", [("assign", 0, 19)]),
    2: ("token=short api_key = longer-value", [("assign", 12, 34)]),
    3: (f"é {KEY} {KEY[:-1]}", [("access", 2, 22)]),
    4: ("0" * 24 + " " + "f" * 23, [("hex", 0, 24)]),
    5: ("secret = " + "ab" * 12, [("assign", 0, 33), ("hex", 9, 33)]),
    6: (None, []),
    7: ("", []),
    8: ("TOKEN\":\"abcdef\" paſſword=abcdefg", [("assign", 0, 14)]),
    9: ("http://me:pass@h/ -----BEGIN RSA PRIVATE KEY-----", [("url_login", 0, 15), ("private_key", 18, 49)]),
    10: ("Bearer abcdefghij0123456789._", [("bearer", 0, 29)]),
    11: ("password password=secretive1", [("assign", 9, 28)]),
}


def found(df, **kw):
    return {(r["doc_id"], tuple(tuple(s) for s in r["spans"])) for r in ss.find_secrets(df, **kw).collect()}


def test_spans(docs):
    df = docs(*[(i, t) for i, (t, _) in CASES.items()])
    assert found(df) == {(i, tuple(s)) for i, (_, s) in CASES.items()}


def test_the_screen_loses_nothing(documents):
    text = documents.select(F.coalesce("text", F.lit("")).alias("text"), ss.may_hold(F.coalesce("text", F.lit(""))).alias("maybe"))
    for r in text.collect():
        assert r["maybe"] or not ss.scan(r["text"])


def test_long_repeated_and_empty(docs, spark):
    long = "token = abcdefgh " * 20_000
    rows = ss.find_secrets(docs((1, long), (1, long), (None, long))).collect()
    assert len(rows) == 3 and all(len(r["spans"]) == 20_000 for r in rows)
    assert ss.find_secrets(docs().filter("false")).count() == 0


def test_only_unseen_pairs_are_scanned(docs, spark, monkeypatch):
    ledger = ss.Ledger(spark, scratch(spark, "ledger"))
    first = docs((1, CASES[1][0]), (2, CASES[1][0]), (3, "clean"))
    again = docs((4, CASES[1][0]), (5, CASES[5][0]))
    ss.find_secrets(first, ledger).collect()
    assert ledger.scanned(ss.VERSION).count() == 2 and ledger.findings(ss.VERSION).count() == 1
    seen = []
    real = ss._scan_rows
    monkeypatch.setattr(ss, "_scan_rows", lambda rows, rules: seen.extend(rows.collect()) or real(rows, rules))
    assert found(again, ledger=ledger) == {(4, tuple(CASES[1][1])), (5, tuple(CASES[5][1]))}
    assert [r["text"] for r in seen] == [CASES[5][0]]
    seen.clear()
    assert found(first, ledger=ledger, version="2") == {(1, tuple(CASES[1][1])), (2, tuple(CASES[1][1])), (3, ())}
    assert len(seen) == 1


def test_redact(docs):
    df = ss.find_secrets(docs((1, CASES[5][0]), (2, "clean"))).join(docs((1, CASES[5][0]), (2, "clean")).select("doc_id", "text"), "doc_id")
    assert {r[0] for r in df.select(ss.redact(F.col("text"), F.col("spans"))).collect()} == {"[assign]", "clean"}


def pem(kind, lines, end=True, gap="\n"):
    body = gap.join([("Mq7/+z" + "abcXYZ012" * 7)[:64]] * lines + ["Tail9Q=="])
    return f"-----BEGIN {kind}PRIVATE KEY-----{gap}{body}" + (f"{gap}-----END {kind}PRIVATE KEY-----" if end else "")


def test_the_body_of_a_private_key_goes(docs):
    keys = [pem(k, n, e, g) for k in ("", "RSA ", "ENCRYPTED ") for n in (1, 20) for e in (True, False) for g in ("\n", "\\n", " ", "\r\n")]
    keys.append("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + "Qz9/" * 16 + "\nTail9Q==")
    df = docs(*[(i, f"before {k}\n\n- after, all the same") for i, k in enumerate(keys)])
    rows = ss.find_secrets(df).join(df.select("doc_id", "text"), "doc_id")
    out = {r["doc_id"]: r["x"] for r in rows.select("doc_id", ss.redact(F.col("text"), F.col("spans")).alias("x")).collect()}
    assert out == {i: "before [private_key]\n\n- after, all the same" for i in range(len(keys))}


def test_a_header_alone_takes_no_prose():
    for text in ("-----BEGIN RSA PRIVATE KEY----- is the first line of a key", "-----BEGIN PRIVATE KEY----- x -----BEGIN PRIVATE KEY-----"):
        assert all(text[a:b].endswith("-----") and text[a:b].count("BEGIN") == 1 for _, a, b in ss.scan(text))


def test_logins_without_user_or_with_long_parts(docs):
    urls = ["redis://:passw0rd@", f"https://u:{'x' * 3000}@", f"https://{'u' * 300}:pass@"]
    assert found(docs(*enumerate(urls))) == {(i, (("url_login", 0, len(u)),)) for i, u in enumerate(urls)}


def test_redaction_of_many_spans_is_one_pass():
    text = "é token = abcdefgh " * 50_000
    assert ss.redacted(text, ss.scan(text)) == "é [assign] " * 50_000
    assert ss.redacted("abcdef", [("a", 0, 4), ("b", 2, 3), ("c", 3, 5), ("d", 5, 6)]) == "[a][d]"
    assert ss.redacted("", []) == ""
