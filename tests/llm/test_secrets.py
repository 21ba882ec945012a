import hashlib
import random
import re

from pyspark.sql import functions as F

from skyloom.llm import secret_scan as s
from skyloom.llm.common import load
from skyloom.llm.queries import op5_secrets


def by_hand(text):
    """Base spans by plain scanning."""
    out = []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, at = ("password", "passwd", "secret", "token", "api_key", "apikey"), 0
    ok = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while at < len(text):
        word = next((w for w in words if low.startswith(w, at)), None)
        end = None
        if word:
            k = at + len(word)
            k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] and text[k] in ":=":
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                e = k
                while e < len(text) and text[e] in ok:
                    e += 1
                if e > k:
                    end = e
                    if e - k >= 6:
                        out.append((at, "assign", e))
        at = end or at + 1
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        out += [(m.start(), "access", m.end())] * (m.end() - m.start() >= 20)
    for m in re.finditer("[0-9a-f]+", text):
        out += [(m.start(), "hex", m.end())] * (m.end() - m.start() >= 24)
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], order.index(x[1]))))


CASES = [
    "", "no secrets here: fine", 'token = "abc"', "token: api_key=abcdefg", "secret=token :abcdefgh", "Password:hunter22 and PASSWD='x y'", "apikey=abcdef api_key = 'abcdefgh'", "ſecret=abcdefgh toKen=abcdefgh",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIAAKIA" + "C" * 20, "f" * 23 + " " + "0" * 24 + "g" + "a1" * 30, "é😀 token=äbcdefgh token=abcdefgh", "token\t=abcdefgh", 'secret"  :  "abc.def=" tail',
]


def test_base_spans_against_a_plain_scanner(spark, sf):
    for text in CASES:
        assert s.listed(s.scan(text)[0]) == by_hand(text), text
    docs = {r["doc_id"]: r["text"] or "" for r in load(spark, sf, "documents").collect()}
    rows = op5_secrets(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = by_hand(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in want.split(",")) for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def literals(text):
    return [text[a:b] for a, k, b in s.scan(text)[1] if s.KINDS[k] == "literal"]


def test_names_literals_and_constants():
    assert literals('db_pwd = "x9!Kq27ZpL"') == ["x9!Kq27ZpL"]
    assert literals('K = "x9Kq27ZpLw"\nprint(1)\ncfg.clientCredential = K') == ["x9Kq27ZpLw"]
    assert literals("{'private_key': 'Zk81_qPw0-aR'}") == ["Zk81_qPw0-aR"]
    assert literals('A = "q7Rt"\nB = "z81Kw0"\nauth = A + "p3Lm9x" + B') == ["z81Kw0", "p3Lm9x"]
    assert literals("signing_key: Zk81qPw0aRx7") == ["Zk81qPw0aRx7"]
    for clean in ('name = "x9!Kq27ZpL"', 'pwd = "changeme"', "pwd = os.environ['PWD']", "if pwd == 'x9Kq27ZpL':", "key: value", "Note: the key to it = patience", "pwd = ${SECRET_PWD}", "time 12:30:45, ratio a:b", 'credentials = "please ask the owner of it first"'):
        assert literals(clean) == [], clean
    assert s.scan('token = "abcdef1234"')[1] == s.scan('token = "abcdef1234"')[0]


def test_typed_assignments():
    secret = "x9!Kq27ZpL"
    for typed in ("db_pwd: str = {}", "const apiCred: string = {};", "private authToken?: string | null = {}", "val dbPass: String? = {}", "let signingKey: Optional<String> = {}", "static API_CRED: &'static str = {};",
                  "db_pwd: Optional[Dict[str, str]] = {}", "let pwd: std::string::String = {}", "creds: string[] = {}", "db_pwd: 'SecretStr' = {}", "const PWD: &[u8] = b{}"):
        assert literals(typed.format(f'"{secret}"')) == [secret], typed
    assert literals(f'K: str = "{secret}"\ncfg.db_pwd = K') == [secret]
    assert literals(f'K: Final[str] = "{secret}"\nconst dbPwd: string = K') == [secret]
    assert literals(f"log: auth={secret}") == [secret]
    for clean in (f'label: str = "{secret}"', f'label: str = "{secret}"\ndb_pwd = str(x)', "pwd: SecretStr = load()", 'pwd: str = "changeme"', "pwd: str == 3"):
        assert literals(clean) == [], clean


def test_joined_constants_cost_no_more_than_their_text():
    text = 'a = "x9Kq27ZpLw"\n' + "a = a + a\n" * 60 + "db_pwd = a\n"
    assert literals(text) == ["x9Kq27ZpLw"]
    chain = 'a = "x9Kq27ZpLw"\n' + "".join(f'a = a + "p{i}Lm9x"\n' for i in range(3000))
    assert literals(chain) == [] and len(literals(chain + "auth = a")) > 1000


def test_more_syntax():
    secret = "x9!Kq27ZpL"
    long = "_n" * 90
    for form in ('db_pwd = """{}"""', "db_pwd = \'\'\'{}\'\'\'", 'user, db_pwd = "ann", "{}"', 'call(x, db_pwd="{}")', "<dbPassword>{}</dbPassword>", "<cred kind='a'> {} </cred>", 'db_pwd = ("{}")', f'db_pwd{long} = "{{}}"',
                 'K = "{}"\nurl = f"at {{K}}"\nauth = f"Basic {{K}}"', 'const k = "{}";\nconst auth = `Bearer ${{k}}`;'):
        assert secret in literals(form.format(secret)), form
    assert literals('db_pwd = ("q7Rt9!kPz0"\n  "z81Kw0-xYq")') == ["q7Rt9!kPz0", "z81Kw0-xYq"]
    assert literals('db_pwd = "q7Rt9!kPz0" "z81Kw0-xYq"') == ["q7Rt9!kPz0", "z81Kw0-xYq"]
    for clean in (f'user, label = "ann", "{secret}"', f"<name>{secret}</name>", f'pwd = ask()\nlabel = "{secret}"', '"""a page of text"""', f'a, pwd = "{secret}", "ann"'):
        assert literals(clean) == [], clean


def test_generated_corpus_against_what_was_planted():
    rng = random.Random(9)
    names = {True: ["db_pwd", "apiCred", "clientSecret", "signing_key", "authBearer"], False: ["label", "colour", "city", "note_id"]}
    for _ in range(300):
        text, want, held = "", [], {}
        for k in range(rng.randint(1, 6)):
            telling = rng.random() < 0.5
            name = f"{rng.choice(names[telling])}{k}" if rng.random() < 0.5 else f"cfg.{rng.choice(names[telling])}"
            if held and rng.random() < 0.4:
                source = rng.choice(sorted(held))
                text += f"{name} = {source}\n"
                want += held[source] if telling else []
                held[name] = held[source]
            else:
                value = "".join(rng.choice("Zq8kP2wX7vR4") for _ in range(14))
                text += rng.choice(["{} = '{}'", 'let {}: string = "{}";', '"{}": "{}",', "{}: {}"]).format(name, value) + "\n"
                held[name] = [value]
                want += [value] if telling else []
        base = [text[a:b] for a, k, b in s.scan(text)[0]]
        assert {x for x in want if not any(x in y for y in base)} == set(literals(text)), text


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "token=abcdefgh", "b"), (2, "w " * 100_000 + "token=abcdefgh", "c"), (2, "token=abcdefgh", "d"), (2, "token=abcdefgh", "d")], "doc_id long, text string, spans string")
    got = s.find_secrets(docs).collect()
    assert [(r["doc_id"], r["spans"]) for r in got] == [(1, ""), (None, "assign:0:14"), (2, "assign:200000:200014"), (2, "assign:0:14"), (2, "assign:0:14")]
    assert s.find_secrets(docs.limit(0)).count() == 0
    assert s.find_secrets(docs).select(F.sha2("base_spans", 256)).first()[0] == s.sha256_hex("")
