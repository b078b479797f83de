"""Secret scans on lines written by hand, as they stand in code, settings, mails and chats: which hold a secret, which do not."""

from tidemark.llm import secrets

#: Lines with a credential value that someone could use.
HELD = [
    'password = "correct horse battery staple"', "passphrase: 'seven purple walruses juggle at dawn'", 'db_password="Tr0ub4dor&3xQ"', "PASSWORD=8fJ#kd02!mQz", "pwd: hV7$wq9Lm", "login: root / password: zK9vLq2TxP", "my password is set, password=Gh5%tR2!pW",
    'secret: "9c!Vb2#Lq8"', "client_secret = 'Zx81-Qp44-Lm20-Rt7'", "token=ghp_R4nd0mT0k3nV4lu3XyZ9", 'api_key: "pk_live_51HxQz8LmN2"', "API-KEY: 7Hq2.ZvP9-Lk3x", 'access_key="Qz7/Lm+2xVp9"', "credential: Nw3!xK8@zR", "passwd = vR8^mK2&qLz",
    "  password: 'p@$$w0rd-Xk29-zQ'", 'spring.datasource.password=Kd82!lQmZ0', 'export DB_PASSWORD="w!Z8q#L2v"', "curl -H 'token: 3f9K!lQz82Vm'", "<add key=\"x\" password='Lm2#Qz9!vK' />", "pwd=Yt6!Rz3#Wn;", "secret=aZ3$kP9!xQ2w", "the wifi password: Blau7!Krokodil92",
    "API_KEY=sk-2fQ9xLmZ81vK0pRt", 'token = "eyJ0.Zk9x.Qm2L"', "passphrase = \"velvet-anchor-47-mosaic-drum\"", "Passwort/password: Xq7_Lm2-Vz9", "password='Nf8)kQ2(zL'", 'secret = "blue77!Heron_kite"', "credential='Rk29-vXz!81q'",
]
#: Lines without one: placeholders, code, prose, values that anyone guesses.
FREE = [
    "token = get_token(request.user)", '"secret": "${SECRET_VALUE}"', "api_key: <your-api-key-here>", 'password = os.environ["X"]', "password: process.env.DB_PASSWORD", "password = self.config.password", 'password = config["db"]["pass"]', "token: {{ vault_token }}", 'password="********"', "secret: xxxxxxxx",
    'password = "changeme"', "password: password123", "pwd=admin2024", 'password = "qwerty12345"', "secret = 'secret'", "token = null", "token: undefined;", "password=letmein!", 'api_key = "YOUR_API_KEY"', "api_key: 'insert your key here'", "password: please enter your password", 'password = "must be at least eight characters"',
    "password: $DB_PASS", "secret: %SECRET%", 'token = f"{token}"', "password: [redacted]", "password = getpass.getpass()", "api_key = settings.API_KEY", "token := tokenizer.next()", "password: 11111111", "password = abcdefgh", "token = new Token(a, b)", "secret=$(cat secret.txt)", 'password: "example password"', "pwd = \"the password is wrong\"",
    "secret: 2024-01-31", "password: aaaaaaaaaaaa", "token: asdfghjkl", "password=Summer2023", 'const password = req.body.password;', "api_key = None", "passwd: monkey1", "token = self::TOKEN", "secret = await vault.read()", "password: {password}", "password = \"<password>\"",
]


def added(line):
    """Whether the method adds a span; what the fixed patterns find stays, right or wrong."""
    return bool(secrets.added_spans(line, secrets.base_spans(line)))


def found(line):
    return bool(secrets.base_spans(line)) or added(line)


def test_lines_written_by_hand():
    missed, wrong = [x for x in HELD if not found(x)], [x for x in FREE if added(x)]
    hit = len(HELD) - len(missed)
    assert hit / len(HELD) >= 0.9, missed
    assert hit / (hit + len(wrong)) >= 0.9, wrong


def test_spans_cover_the_whole_value():
    line = 'x password = "correct horse battery staple" y'
    (_, a, b), = secrets.added_spans(line, [])
    assert line[a:b] == 'password = "correct horse battery staple"'


def test_hidden_characters_make_a_placeholder_only_where_little_else_is_shown():
    for value, stands in (("sk-xxxxxxxx", True), ("abc...xyz", True), ("kQ9!zXXXX7w#Lm2", False), ("p4!Zq...8Lm#vK", False), ("***", True)):
        assert secrets.stands_for(value, True) == stands


def test_words_are_ranked_by_the_documents(spark):
    docs = spark.createDataFrame([(1, "heron heron kite Heron, x1y 12 ab password"), (2, "kite velvet"), (3, None)], "doc_id long, text string")
    ranks = secrets.word_ranks(docs, 2)
    n = len(secrets.WORDS)
    assert (ranks["heron"], ranks["kite"]) == (n + 1, n + 2) and "velvet" not in ranks and ranks["password"] == 1
    assert secrets.piece_cost("heron", ranks) < secrets.piece_cost("heron")
    assert secrets.word_ranks(docs.where("false")) == secrets.RANKS
