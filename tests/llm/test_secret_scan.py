import hashlib
import random
import re
import string

from parley.llm import secret_scan as op


def brute(text):
    """Base spans by a plain scan of all pattern matches."""
    text, found = text or "", []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_base_spans_equal_brute_force(spark):
    draw = random.Random(3)
    bits = ["token", "TOKEN=", "api_key: ", "apikey='", "passwd", "secret = ", "=", ":", " ", "\n", "'", "abc", "abcdef", "token=token: abcdefg", "AKIA" + "Z9" * 8, "AKIA1", "0123456789abcdef" * 2, "deadbeef", "é", "K", "ſecret=abcdef", "toKen=abcdefg", "password=p@ss", "x.y-z/"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 25))) for _ in range(300)]
    got = op.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 300
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == [s for s in want.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))


def test_novelty_reports_random_strings_in_sensitive_context_only(spark):
    draw = random.Random(9)
    key = "".join(draw.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [f"Authorization: Bearer {key}", f"the build of {key} is here", "Authorization: Bearer " + "Zx12" * 10, f"{key} is known. Authorization: Bearer {key}", "the session_configuration_version_1_default_value is set"]
    got = {r.doc_id: r.spans for r in op.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == f"novel:22:{22 + len(key)}"
    assert got[1] == got[2] == got[3] == got[4] == ""


def test_key_blocks_copies_and_letters(spark):
    draw = random.Random(5)
    some = lambda n, of=string.ascii_letters + string.digits: "".join(draw.choice(of) for _ in range(n))
    lines = [some(64) for _ in range(12)] + [some(11) + "="]
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END PRIVATE KEY-----"
    key, letters = some(40), some(32, string.ascii_letters)
    texts = [pem, f"Authorization: Bearer {key}\n" * 3, f"Authorization: Bearer {letters}", f"secret: {key}, then Bearer {key}"]
    texts += ["The key responsibilities of the access-control-administrator: internationalization", "session ================", "key 1234567890123456"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [f"{texts[r.doc_id][f.start : f.stop]}" for f in r.found] for r in op.find_secrets(docs).collect()}
    assert got[0] == lines
    assert got[1] == [key] * 3 and got[2] == [letters]
    assert got[3] == [f"secret: {key}", key]
    assert got[4] == got[5] == got[6] == []
    assert not any(x in r.text for r in op.redact(docs).collect() for x in [*lines, key, letters])


def test_redact_keeps_rows_and_columns(awkward):
    out = op.redact_counted(awkward)
    assert out.schema == awkward.schema
    assert out.exceptAll(awkward).filter("text is null").count() == 0 and out.count() == awkward.count()


def test_redact_text(spark):
    df = spark.createDataFrame([(1, "a token=abcdef0123456789abcdef0123456789 b", 42)], "doc_id long, text string, n_chars long")
    r = op.redact_counted(df).first()
    assert r.text == "a [secret] b" and r.n_chars == 12


def test_awkward_and_empty(awkward, nothing):
    got = op.find_secrets(awkward).collect()
    assert len(got) == awkward.count() and all(r.spans == "" for r in got)
    assert op.find_secrets(nothing).count() == 0 and op.redact_counted(nothing).count() == 0
