import hashlib
import random
import re
import time

from vellum.llm import secrets
from vellum.llm.queries import op5_secrets

ID, KEY = "AKIA" + "Q2W3E4R5T6Y7U8I9", "aB3" + "xY7qLm" * 6


def brute_base(text):
    """The contract's wording, kind by kind."""
    found = []
    flags = re.I | re.A
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, flags):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, k) for a, _, b, k in sorted(found)]


TEXTS = [
    None,
    "",
    "nothing here",
    "Password = 'abcdefghijkl' and api_key:short token: token: abcdefghijklmnop",
    f"é\U0001f600 {ID} x 0123456789abcdef0 AKIASHORT",
    "passſword=abcdefghijklmnop secret=" + "f" * 20,
    "token=abc.def-ghi_jkl=mno" * 3,
    "x" * 50_000 + f" {ID} " + "deadbeefdeadbeef",
]


def test_base_matches_the_definition(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x"), (None, TEXTS[4], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.scan_secrets(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    shown = sorted(((r["id"], [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]) for r in got), key=key)
    assert shown == sorted(((i, brute_base(t or "")) for i, t, _ in rows), key=key)


def test_weak_parts_need_their_complement():
    linked = lambda t: [k for _, _, k in secrets.all_spans(t)[1] if k in ("key", "endpoint")]
    assert linked(f"{ID} and {KEY}") == ["key"]
    assert linked(f"{ID} and {KEY} at https://db.example.com/x") == ["key", "endpoint"]
    assert linked(f"{KEY} https://db.example.com/x") == ["key", "endpoint"]
    assert linked("password=abcdefghijklmnop at https://db.example.com/x") == ["endpoint"]
    assert linked(f"{KEY} alone") == linked("https://db.example.com/x alone") == [], "one part"
    assert linked(f"https://db.example.com/{KEY}") == [], "a key inside its only endpoint"
    assert linked("0123456789abcdef0123 https://db.example.com/x") == [], "digits beside an endpoint"
    assert linked(f"{ID} at https://db.example.com/x") == []
    assert linked(f"{ID}\n\n{KEY}") == linked(f"{KEY}\n\nhttps://db.example.com/x") == [], "another scope"
    assert linked(f"{ID} {'.' * 300} {KEY}") == [], "out of reach"
    assert linked(f"{ID} {'lower' * 8}") == [], "not key-like"
    assert linked(f"{ID} {KEY * 9}") == ["key"], "a long key"


def brute_linked(text, reach):
    """Every pair of parts, scope by scope."""
    base = brute_base(text)
    ends = [(m.start(), m.end(), "endpoint") for m in secrets._ENDPOINT.finditer(text)]
    breaks = [m.end() for m in secrets._SCOPE_END.finditer(text)]
    scope = lambda s: sum(b <= s[0] for b in breaks)
    near = lambda s, parts: any(scope(s) == scope(p) and p[0] <= s[1] + reach and p[1] >= s[0] - reach for p in parts)
    over = lambda s, parts: any(p[0] < s[1] and p[1] > s[0] for p in parts)
    ids = [s for s in base if s[2] == "access"]
    keys = []
    for m in secrets._KEY.finditer(text):
        s = (m.start(), m.end(), "key")
        if secrets._mixed(m.group()) and not over(s, base) and (near(s, ids) or (near(s, ends) and not over(s, ends))):
            keys.append(s)
    told = [s for s in base if s[2] == "assign"] + keys
    strong = [s for s in base if s[2] != "access"] + keys
    return keys + [s for s in ends if near(s, told) or (near(s, ids) and near(s, strong))]


def test_linked_spans_match_brute_force():
    rng, found = random.Random(6), 0
    parts = [ID, KEY, KEY[:25] + "==", "https://a.example/x", "ftp://h/" + KEY[:22], "password: abcdefghijklmnop", "deadbeef" * 3, "word", "\n\n", " \n \n ", "." * 30, ". " * 60]
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        for reach in (5, 60, 240):
            got = secrets.linked_spans(text, secrets.base_spans(text), reach)
            assert got == brute_linked(text, reach)
            found += len(got)
    assert found > 500


def test_long_texts_take_time_in_proportion():
    def seconds(n):
        text = f"token={'x1Y' * n} {ID} " + f"{KEY} https://h.example/{'a' * 20} word\n" * (n // 50)
        start = time.process_time()
        secrets.all_spans(text)
        return time.process_time() - start

    seconds(1000)
    assert seconds(200_000) < 12 * max(seconds(50_000), 0.02)


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op5_secrets(spark, str(tmp_path)).collect():
        base = brute_base(TEXTS[r["doc_id"]] or "")
        shown = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, _, k in base) for x in ("assign", "access", "hex")]


def test_redaction(spark):
    text = f"a {ID} b password={'ab12' * 5} c"
    docs = spark.createDataFrame([(1, text, len(text), "x", 1), (2, None, None, "y", 2), (3, "ok", 2, "z", 3)], "doc_id long, text string, n_chars long, spans string, value int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_documents(docs).collect()}
    clean = "a [REDACTED] b [REDACTED] c"
    assert got == {1: (clean, len(clean)), 2: (None, None), 3: ("ok", 2)}
    assert secrets.redact_documents(docs.limit(0)).collect() == []
