"""The assignment lexer against labelled snippets of many syntaxes, and its cost on hostile texts."""

import time

from icuflow.llm import credentials

K, J = "q7Zp9x2LmN", "aB3dE5fG7h"


def found(text):
    return [text[s[0] : s[1]] for s in credentials.lexed_spans(text)]


SNIPPETS = [  # text, its credentials in order
    (f'db_password: str = "{K}"', [K]),
    (f'db_password: Optional[str] = "{K}"', [K]),
    (f'db_password: str | None = "{K}"', [K]),
    (f'const authToken: string = "{K}";', [K]),
    (f'val dbPassword: String = "{K}"', [K]),
    (f"let client_secret: &'static str = \"{K}\";", [K]),
    (f'var dbPassword string = "{K}"', [K]),
    (f'apiKey := "{K}"', [K]),
    (f'String dbPassword = "{K}";', [K]),
    (f'private static final String API_KEY = "{K}";', [K]),
    (f'char db_password[] = "{K}";', [K]),
    (f'char db_password[64] = "{K}";', [K]),
    (f'const char *db_password = "{K}";', [K]),
    (f'#define DB_PASSWORD "{K}"', [K]),
    (f'SECRET_KEY = """{K}"""', [K]),
    (f"SECRET_KEY = r'''{K}'''", [K]),
    (f'SECRET_KEY = b"{K}"', [K]),
    (f'private_key = """\n-----BEGIN KEY-----\n{K}\n{J}\n-----END KEY-----\n"""', [K, J]),
    (f"client_secret: >-\n  {K}\nnext: 1", [K]),
    (f"a:\n  private_key: |\n    {K}\n    {J}\n  next: 1", [K, J]),
    (f"user, db_password = \"bob\", \"{K}\"", [K]),
    (f'db_password, user = "{K}", "bobbobbob1"', [K]),
    (f'tokens = ["{K}", "{J}"]', [K, J]),
    (f'String[] tokens = {{ "{K}", "{J}" }};', [K, J]),
    (f'{{"tokens": ["{K}",\n  "{J}"]}}', [K, J]),
    ('db_password = ("q7Zp9x" "2LmN")', ["q7Zp9x", "2LmN"]),
    ('db_password = ("q7Zp9x"\n    "2LmN")', ["q7Zp9x", "2LmN"]),
    ('db_password = "q7Zp9x" \\\n    "2LmN"', ["q7Zp9x", "2LmN"]),
    ('String dbPassword = "q7Zp9x"\n    + "2LmN";', ["q7Zp9x", "2LmN"]),
    ("$db_password = 'q7Zp9x' . '2LmN';", ["q7Zp9x", "2LmN"]),
    ('db_password = "q7Zp9x" .. "2LmN"', ["q7Zp9x", "2LmN"]),
    (f'x = "{K}"\ndb_password = f"{{x}}"', [K]),
    (f'x = "{K}"\ndb_password = f"pre-{{x}}"', [K, "pre-"]),
    (f"x='{K}'\nDB_PASSWORD=\"${{x}}\"", [K]),
    (f'x = "{K}"\ny = x\ndb_password = y', [K]),
    (f'db_password = os.environ.get("DB_PASSWORD", "{K}")', [K]),
    (f'db_password = os.getenv("X") or "{K}"', [K]),
    (f'db_password = os.getenv("API_KEY", "{J}") or "{K}"', [J, K]),
    (f'aws_secret_access_key = "{K}"', [K]),
    (f'access_key: {K}', [K]),
    (f'const dbPassword = process.env.DB_PASSWORD || "{K}";', [K]),
    (f'props.put("db.password", "{K}");', [K]),
    (f'conn.setPassword("{K}");', [K]),
    (f'connect(host="db", db_password="{K}")', [K]),
    (f'dict(user="bob", passwd="{K}")', [K]),
    (f'cfg["client_secret"] = "{K}"', [K]),
    (f"cfg['a']['client_secret'] = '{K}'", [K]),
    (f'self.db_password = "{K}"', [K]),
    (f'this->db_password = "{K}";', [K]),
    (f'"client_secret" => "{K}",', [K]),
    (f':client_secret => "{K}"', [K]),
    (f'<add key="DbPassword" value="{K}"/>', [K]),
    (f'<property name="db.password">{K}</property>', [K]),
    (f"<password>\n  {K}\n</password>", [K]),
    (f"<secret><![CDATA[{K}]]></secret>", [K]),
    (f'<server password="{K}" host="db">', [K]),
    (f'conn = "Server=db;Password={K};"', [K]),
    (f'body = "{{\\"api_key\\": \\"{K}\\"}}"', [K]),
    (f"body = '{{\"api_key\": \"{K}\"}}'", [K]),
    (f"export DB_PASSWORD={K}", [K]),
    (f"db.password={K}\ndb.user=bob", [K]),
    (f"smtp_pass = '{K}'", [K]),
    (f'db_password ?= "{K}"', [K]),
    (f'/* old */ db_password = "{K}" # rotate', [K]),
    ("private_key = load_key_from_vault", []),
    ("private_key = load_key(path)", []),
    ('my_passwd_file = "/etc/app/passwd.conf"', []),
    ('private_key = "/etc/keys/server.pem"', []),
    ('token_url = "https://example.org/oauth/Token2"', []),
    ('client_secret = "https://vault.example.org/v1/Data2"', []),
    ("secret_name: production-database", []),
    ("token: userToken", []),
    (f'if password == "{K}" or password != "{J}":', []),
    (f'colour = "{K}"', []),
    ('db_password = "changeme"', []),
    ("db_password = ${DB_PASSWORD}", []),
    ('<password></password><input type="password" name="q"/>', []),
    ("def check(token: str, password: str = None):\n    return token", []),
    ("the secret of life: work and rest", []),
    (f'k = "{K}"\nk = other()\ndb_password = k', []),
    ('max_tokens = 100000', []),
]


def test_labelled_snippets():
    wrong, hit, said, true = [], 0, 0, 0
    for text, wanted in SNIPPETS:
        got = found(text)
        hit, said, true = hit + len(set(got) & set(wanted)), said + len(got), true + len(wanted)
        if sorted(got) != sorted(wanted):
            wrong.append((text, got))
    assert not wrong and hit == said == true  # recall and precision are 1 on these


def test_snippets_stand_side_by_side():
    """Whatever stands before and after a snippet, its credentials are found at their places."""
    for text, wanted in SNIPPETS:
        for low, high in (("", "\n"), ("plain words, don't (mind\n\n", "\n\nmore; words: here\n"), ("x = 1;\n", "\n}\n")):
            if text.startswith("client_secret: >") or "'''" in text:
                continue
            whole = low + text + high
            assert sorted(found(whole)) == sorted(wanted), whole


def test_values_beyond_memory_keep_their_literals():
    text = 'k0="abcdef1"\n' + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(3000)) + "password=k3000"
    assert found(text) == ["abcdef1"]
    assert found(text + '\nclient_secret = k3000 + "Q9zz"') == ["abcdef1", "Q9zz"]


def test_hostile_texts_take_time_in_proportion():
    hard = ['"""', "'", '"', '\\"', "<a b=", '<a b="', "<a ", "x = (", "x=[", "a, ", "k: |\n", "<a>", "password = ", "a+", "x = a + ", "${a}", "`", "b'", "a || ", ":", " ", "  k:\n"]
    for part in hard:
        took = []
        for n in (4000, 32000):
            text = "password = x\n" + part * n
            start = time.process_time()
            credentials.spans_of(text)
            took.append(time.process_time() - start)
        assert took[1] < 40 * took[0] + 1.0, (part, took)


def test_every_sensitive_name_holds_a_mention():
    names = [*credentials.SENSITIVE, *("".join(p) for p in credentials.PAIRS)]
    assert all(any(w in name for w in credentials.MENTIONS) for name in names)
