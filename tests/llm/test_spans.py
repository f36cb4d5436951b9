"""Secrets and PII: plain formats against plain patterns, and what the methods add."""
import hashlib
import random
import re

from cohortlens.llm import pii, secrets

SECRET = [re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
          re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
PII = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"),
       re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in SECRET[0].finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in SECRET[1].finditer(t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in SECRET[2].finditer(t) if len(m[0]) >= 24])


def plain_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, m.start(), m.end()) for m in PII[0].finditer(t)]
    out += [(1, m.start(), m.end()) for m in PII[1].finditer(t) if all(int(x) < 256 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in PII[2].finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(3, m.start(), m.end()) for m in PII[3].finditer(t) if 8 <= len(digits(m)) <= 15])


def noise(alphabet, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(n)]


def test_plain_secret_formats():
    words = ["token", "API_key", "pass", "passwd", "SECRET", "apiKey", "=", ":", " ", '"', "'", "AKIA", "0af3", "Z9", "\n", "ſecret", "toKen"]
    for t in noise(words, 8000, 1):
        assert secrets.base_spans(t) == plain_secrets(t)
    assert secrets.base_spans("token=" + "a" * 6) and not secrets.base_spans("token=" + "a" * 5)


def test_lexer_finds_and_leaves_alone():
    found = lambda t: [t[s:e] for s, e in secrets.literal_spans(t)]
    assert found('db_pwd: str = "hunter22x!"') == ["hunter22x!"]
    assert found('{"user": "bob", "clientSecret": "aB3dE5fG7hI9"}') == ["aB3dE5fG7hI9"]
    assert found('A = "sk9f8a7s"\nb = A + "9d8f7g"\nDB_PASSPHRASE = b') == ["sk9f8a7s", "9d8f7g"]
    assert found("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPx") == ["wJalrXUtnFEMIK7MDENGbPx"]
    for clean in ('password: changeme', 'token_file = "/etc/a/b.txt"', "password=${DB_PASSWORD}", 'pass = getpass("hello there")',
                  'secret = "two words here"', 'name = "aB3dE5fG7hI9"', "The key: value of things. Max tokens: 100000", '"open token = x'):
        assert found(clean) == []
    assert len(found("x = y\n" * 5000 + 'api_key = "aB3dE5fG7hI9x"')) == 1


def test_every_literal_of_a_binding_counts():
    parts = [f"k{i}Zq{i * 7919 % 9973:04d}" for i in range(300)]
    found = lambda t: [t[s:e] for s, e in secrets.literal_spans(t)]
    line = " + ".join(f'"{p}"' for p in parts)
    assert found(f"api_secret = {line}") == parts
    assert found(f"a = {line}\nb = a\nclient_secret = b + a") == parts
    steps = "".join(f'a{i + 1} = a{i} + "{p}"\n' for i, p in enumerate(parts))
    assert found(f'a0 = "q7Rr5Tt9"\n{steps}db_password = a{len(parts)}') == ["q7Rr5Tt9", *parts]
    doubled = 'a = "q7Rr5Tt9"\n' + "a = a + a\n" * 20_000 + "password = a + a"
    assert found(doubled) == ["q7Rr5Tt9"]
    assert found('a = "q7Rr5Tt9"\nb = a\na = "none here"\npassword = a') == []


def test_secret_rows(awkward, clashing, empty):
    want = sorted((str(r.doc_id), hashlib.sha256(secrets.join_spans(plain_secrets(r.text or ""), secrets.KINDS).encode()).hexdigest())
                  for r in awkward.collect())
    rows = secrets.scan_secrets(clashing).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    hit = [r for r in rows if r.spans]
    assert [r.doc_id for r in hit] == [60] and (hit[0].n_assign, hit[0].n_hex, hit[0].n_literal) == (1, 1, 1)
    masked = secrets.redact_secrets(clashing)
    assert masked.columns == clashing.columns
    text = {str(r.doc_id): r.text for r in masked.collect()}
    assert "b44e15" not in text["60"] and text["60"].endswith("10.0.0.1") and text["50"] is None
    assert sum(a.text != b.text for a, b in zip(sorted(awkward.collect(), key=str), sorted(masked.select(awkward.columns).collect(), key=str))) == 1
    assert secrets.scan_secrets(empty).count() == 0 and secrets.redact_secrets(empty).count() == 0


def test_plain_pii_formats():
    for t in noise("0123456789.@-+ ()ab", 8000, 2) + ["a@b@c.d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1.2.3", "0255.1.1.1"]:
        assert pii.candidates(t)[0] == plain_pii(t)


def test_pii_learns_from_context(spark, awkward, clashing, empty):
    r = random.Random(5)
    rows = []
    for i in range(1200):
        a, b, c = r.randrange(200, 999), r.randrange(200, 999), r.randrange(1000, 9999)
        rows.append((i, r.choice(["call my mobile ", "phone: ", "order number ", "invoice ", "see page ", "tel "]) + f"{a}-{b}-{c} soon"))
        rows.append((5000 + i, "nothing to see in this text"))
    out = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    hits = [(("page" in text[k] or "order" in text[k] or "invoice" in text[k]), x.n_added) for k, x in out.items() if k < 5000]
    assert sum(n for bad, n in hits if not bad) > 0.9 * sum(not bad for bad, _ in hits)
    assert sum(n for bad, n in hits if bad) < 0.05 * sum(bad for bad, _ in hits)
    assert all(not out[k].spans for k in out if k >= 5000)
    want = sorted((str(x.doc_id), hashlib.sha256(pii.join_spans(plain_pii(x.text or "")).encode()).hexdigest()) for x in awkward.collect())
    assert sorted((str(x.doc_id), x.base_sha256) for x in pii.find_pii(clashing).collect()) == want
    assert pii.find_pii(empty).count() == 0


def literals(text):
    return [text[a:b] for a, b in secrets.literal_spans(text)]


def test_forms_of_the_right_hand_side():
    one = ["hunter22x!"]
    for text in ('password = b"hunter22x!"', 'password = ("hunter22x!")', 'password = [["hunter22x!"]]',
                 'password = os.environ.get("X", "hunter22x!")', 'password: Optional[str] = "hunter22x!"',
                 'password: Dict[str, int] = "hunter22x!"', '{"a": {"password": "hunter22x!"}}',
                 'def f(password="hunter22x!"): pass', 'x = "hunter22x!"\npassword = (x)'):
        assert literals(text) == one, text
    assert literals('passwords = ["hunter22x!",\n "zebra99Q!"]') == ["hunter22x!", "zebra99Q!"]
    assert literals('password = "hunter" + \\\n "22x!abc"') == ["hunter", "22x!abc"]
    assert literals('password = (\n "hunter22"\n "x9!Qabc")') == ["hunter22", "x9!Qabc"]
    assert literals('password = getpass("Enter it please99")') == []      # a prompt
    assert literals(r'password = "a\"b99Xyz!"') == [r'a\"b99Xyz!']


def test_tokens_match_a_scanning_pattern():
    """Closing quotes looked up from the end are those that a scan from each opening quote finds."""
    strings = re.compile(r'''"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|["'`]''')
    for text in noise("\"'`\\\n =ab", 300, 7):
        want = [(m.start(), m.end()) for m in strings.finditer(text)]
        got = [(s, e) for k, s, e in secrets.tokens(text) if k == "str" or (k == "other" and text[s] in "\"'`")]
        assert got == want, text


def test_long_lines_take_linear_time():
    import time
    for text in ('password = ' + '\\"' * 150_000, "k:" * 150_000, "a = [" * 60_000, "a = [" * 30_000 + "]" * 30_000,
                 "\\" * 300_000 + ' = "x', "a = f(" * 30_000 + ")" * 30_000):
        began = time.time()
        secrets.scan(text)
        assert time.time() - began < 20          # minutes where each quote or bracket looks along the line
    text = " ".join(f"+1 555 {i:07d}" for i in range(20_000))
    began = time.time()
    base, cands = pii.candidates(text)
    kept = pii.free_spans([], [{"p": 0.9, "kind": k, "s": s, "e": e} for k, s, e, _, _ in cands])
    assert time.time() - began < 40 and len(base) == 20_000 == len(kept)


def test_free_spans_match_all_comparisons():
    r = random.Random(4)
    for _ in range(200):
        base = sorted((0, s, s + r.randint(1, 9)) for s in (r.randrange(80) for _ in range(4)))
        added = [{"p": r.choice([.9, .95, 1.0]), "kind": r.randint(4, 9), "s": s, "e": s + r.randint(1, 12)}
                 for s in (r.randrange(80) for _ in range(12))]
        taken, want = [(s, e) for _, s, e in base], []
        for x in sorted(added, key=lambda x: (-x["p"], x["s"] - x["e"], x["kind"], x["s"])):
            if not any(a < x["e"] and x["s"] < b for a, b in taken):
                taken.append((x["s"], x["e"]))
                want.append((x["kind"], x["s"], x["e"]))
        assert pii.free_spans(base, added) == want


def test_letters_only_addresses_and_far_reaching_spans(monkeypatch):
    import numpy as np
    b = np.frombuffer("dead:beef::cafe see".encode(), np.uint8)
    assert pii.suspects(b, np.array([0, len(b)])).tolist() == [True]
    # a candidate touches a base span, however many shorter ones begin after that
    monkeypatch.setattr(pii, "weak_label", lambda kind, span, around, touching: int(touching))
    for text in noise("+1.2 3-4567890", 300, 3) + ["+1 2.3.4.5 1.2.3.4 1.1.1.1 2.2.2.2 3.3.3.3 555-123-4567"]:
        base, cands = pii.candidates(text)
        for kind, s, e, label, _ in cands[len(pii.base_matches(text)):]:
            assert label == any(a < e and s < z for _, a, z in base)
