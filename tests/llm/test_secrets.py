import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import secrets


def plain_base(text):
    """The contract's patterns, read one character at a time where they are simple runs."""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, rank, head, chars, least in (("access", 1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), ("hex", 2, "", "0123456789abcdef", 16)):
        i = 0
        while i < len(text):
            j = i + len(head)
            if text.startswith(head, i) and j < len(text) and text[j] in chars:
                while j < len(text) and text[j] in chars:
                    j += 1
                if j - i >= least:
                    found.append((i, rank, f"{kind}:{i}:{j}"))
                i = j
            else:
                i += 1
    return [s for _, _, s in sorted(found)]


def test_base_equals_brute_force(corpus, texts):
    for r in secrets.scan(corpus).collect():
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(","))


def test_failing_matches_use_up_their_text():
    assert secrets.base_spans("password: secret: abcdefghijklmn") == []
    assert secrets.base_spans("PassWord='abcdefghijkl'") == [("assign", 0, 22)]
    assert secrets.base_spans("paſſword=abcdefghijkl") == []
    assert secrets.base_spans("AKIA" + "A" * 13) == [] and secrets.base_spans("AKIA" + "A" * 14) == [("access", 0, 18)]


def literals(text):
    return [text[a:b] for a, b in secrets.lexed_spans(text)]


def test_lexer():
    assert literals('db_passwd = "hunter2-Kx81-qz"') == ["hunter2-Kx81-qz"]
    assert literals("{'clientSecret': 'aZ3kd93kdLq02', 'name': 'aZ3kd93kdLq02x'}") == ["aZ3kd93kdLq02"]
    assert literals("api_key: q8Rk2LmZ0tYw\nport: 8080") == ["q8Rk2LmZ0tYw"]
    assert literals('PRIVATE_KEY := "aB3dE5gH7jK9mN1p"') == ["aB3dE5gH7jK9mN1p"]
    assert literals("--auth-token=Zx81kqP0mLw2") == ["Zx81kqP0mLw2"]


def test_subscripts():
    for target in ('os.environ["API_SECRET"]', "config['password']", 'c["db"]["password"]', "config[PASSWORD]", "password[0]", "tokens['auth-token'] "):
        assert literals(f'{target} = "q8Rk2LmZ0tYw"') == ["q8Rk2LmZ0tYw"], target
    assert literals("c['title'] = 'q8Rk2LmZ0tYw'") == [] and literals("] = 'q8Rk2LmZ0tYw'") == [] and literals("'] = 'q8Rk2LmZ0tYw'") == []


def test_typed_declarations():
    for left in ("password: str", "const apiToken: string", "def f(secret: Optional[str]", "token: dict[str, list[str]] | None", "const TOKEN: &'static str", "passwd?: string", "note: password"):
        assert literals(f"{left} = 'q8Rk2LmZ0tYw'") == ["q8Rk2LmZ0tYw"], left
    assert literals("token:str='q8Rk2LmZ0tYw'") == ["q8Rk2LmZ0tYw"]
    assert literals("password: str = BASE") == [] and literals("B: str = 'q8Rk2LmZ0tYw'\npassword: str = B") == ["q8Rk2LmZ0tYw"]
    assert literals("password: ApplicationSecretString1 = None") == []
    assert literals("api_key: q8Rk2LmZ0tYw=\n") == ["q8Rk2LmZ0tYw="]


def test_prefixes_and_three_quotes():
    for value in ('b"{}"', "f'{}'", 'r"{}"', "Rb'{}'", '@"{}"', '"""{}"""', "'''{}'''", 'b"""\n{}\n"""'):
        assert literals("password = " + value.replace("{}", "q8Rk2LmZ0tYw")) == ["q8Rk2LmZ0tYw"], value
    assert literals("token = b'q8Rk2L' + b'mZ0tYw'") == ["q8Rk2L' + b'mZ0tYw"]
    assert literals('token = f"{settings.LONG_TOKEN_Name1}"') == []
    assert literals('doc = """\npassword = \'q8Rk2LmZ0tYw\'\n"""') == ["q8Rk2LmZ0tYw"] == literals('log = f"password=q8Rk2LmZ0tYw"')


def test_long_odd_lines_take_linear_time():
    import time

    began = time.time()
    for piece in ("a: b[", "a: b<", "a[0]", "x]=", 'x = """', "a: b | ", "a: b[]", "x = b'", "a:b[<"):
        secrets.lexed_spans(piece * 40_000)
        secrets.lexed_spans("k: v" + piece * 40_000 + " = 'x'")
    assert time.time() - began < 60


def plain_score(value):
    import math

    if len(value) < 8 or re.search(r"\s", value):
        return 0
    if re.match(r"(?i)(x+|\*+|\.+|none|null|true|false|changeme|change_me|example|placeholder|redacted|todo|test|your[_\-].*|<.*>|\$.*|%.*|\{\{.*)\Z", value, re.DOTALL):
        return 0
    shares = [value.count(c) / len(value) for c in set(value)]
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"))
    return (len(value) >= 12) + (len(value) >= 20) + (classes >= 2) + (-sum(p * math.log2(p) for p in shares) >= 3.0)


def plain_lexed(text):
    """Every literal sliced and rated alone, every name looked up among all earlier ones."""
    seen, rated = [], {}
    for name, value, start, end in secrets.assignments(text):
        span, value = (start, end), text[start:end] if value is None else value
        if not text[start - 1 : start] in ("'", '"'):
            for earlier, of, at in reversed(seen):
                if earlier == value:
                    value, span = of, at
                    break
        seen.append((name, value, span))
        score = secrets.name_score(name)
        if score and plain_score(value) and score + plain_score(value) >= secrets.THRESHOLD:
            rated[span] = value
    return sorted(rated)


PIECES = ["password", "token", "a", "B", "x.y", '"', "'", "=", ":", "=", ":=", "=>", " ", "\n", "+", " + ", "[", "]", "(", ")", "q8Rk2LmZ0tYw", "abcdefghijkl", "f", "b", "str", ".", ",", "\\", "|", "&", "xxxxxxxxx", "$FOO12345", "K", "é"]


@settings(max_examples=2_000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_lexed_spans_equal_brute_force(text):
    assert secrets.lexed_spans(text) == plain_lexed(text)


def test_lexed_spans_of_the_corpus_equal_brute_force(texts):
    assert all(secrets.lexed_spans(t or "") == plain_lexed(t or "") for t in texts.values())


def test_a_million_characters_without_a_break():
    import time

    for piece in ("a=", "a:", "x=y&", "password=", "password=$", 'a="', 'a="x"+', "[a]", "token=a.", "[secret]=", "password"):
        began = time.time()
        secrets.lexed_spans("token=" + piece * (1_000_000 // len(piece)))
        secrets.base_spans(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 30, piece


def test_constants_and_concatenation():
    assert literals('BASE = "q8Rk2LmZ0tYw"\npassword = BASE') == ["q8Rk2LmZ0tYw"]
    assert literals("K = 'q8Rk2L'\ncolour = K") == []
    assert literals("secret = 'q8Rk2L' + \"mZ0tYw\"") == ["q8Rk2L' + \"mZ0tYw"]


def test_what_is_no_secret():
    for text in ('password = "changeme"', 'token = "${TOKEN_FROM_ENV}"', 'title = "q8Rk2LmZ0tYw"', 'if token == "q8Rk2LmZ0tYw":', "password: see the manual", 'secret = "aaaaaaaaaaaa"[0]'):
        assert literals(text) in ([], ["aaaaaaaaaaaa"][:0]), text


def test_odd_rows(odd, none):
    got = secrets.scan(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" for r in got)
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(none).count() == 0


def test_many_literals_that_end_at_one_place_take_linear_time():
    """A megabyte each: so many assignments before a run of as many different characters."""
    import time

    wide = "".join(chr(0x10000 + i) for i in range(140_000))
    for text in ("key=" * 215_000 + wide, "token=a&" * 107_000 + wide):
        began = time.time()
        assert len(secrets.lexed_spans(text)) > 100_000
        assert time.time() - began < 60
