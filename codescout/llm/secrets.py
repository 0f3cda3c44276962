"""Problem 4: secrets in programs and settings, by a linear-chain conditional random field.

Lines that can hold a secret are cut into lexical tokens: names and marks of the code, and the words of its
literals, comments and bare settings. A field with two labels (secret, other) scores each token by its shape
and its context; the Viterbi path gives the spans, and these characters alone are replaced. The field is
trained here, by stochastic gradient on the likelihood of generated, labelled lines (`TRAIN_LINES` of them);
its weights depend on nothing in the corpus. Rows are handled where they lie, so there is no shuffle.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_LINES, EPOCHS, RATE, PENALTY = 4800, 5, 0.35, 1e-4
CACHE_LINES = 200_000
REDACTED = "REDACTED"

# --- lexical tokens --------------------------------------------------------------------------------------------------

#: What a line holds that has a literal, a comment, a setting or a flag: a mark before any token that can be labelled, once for each line.
_HOLDS = re.compile(r"(?:[\"'`#:=]|//|/\*|--?[A-Za-z]|\n[ \t]*\*[ \t])[^\n]*")
_PEM = re.compile(r"-----BEGIN (?P<label>[A-Z0-9 ]+)-----(?P<body>[\s\S]*?)(?:-----END [A-Z0-9 ]+-----|(?=[\"'`])|\Z)")
_SEGMENT = re.compile(r"(?P<url>[A-Za-z][\w+.-]*://[^\s:/@\"'`<>]*:)(?P<pass>[^\s@\"'`]+)@|(?P<q>\"\"\"|'''|[\"'`])|(?P<com>//|/\*|#|--\s|^\s*\*\s)|(?P<word>--?[A-Za-z][\w-]*=|[A-Za-z_][\w.-]*|\d[\w.-]*)|(?P<op>:=|=>|[=:(,\[{+])|(?P<rest>\S)")
_INNER = re.compile(r"(?P<url>[A-Za-z][\w+.-]*://[^\s:/@\"'`<>]*:)(?P<pass>[^\s@\"'`]+)@|(?P<flag>(?:--?)?[A-Za-z][\w-]*=)(?=[^\s=\"'`])|(?P<login>(?<=-u )[\w.-]+:|(?<![\w-])-p(?=[^\s\"'`-][^\s\"'`]{5}))|(?P<chunk>[^\s\"'`,;()<>{}]+|[<{][^\s<>{}]*(?: [^<>{}]*)?[>}]+)|(?P<mark>[,;()<>{}])")
_QUOTED = {q: re.compile(rf"(?:[^{q}\\]|\\.)*") for q in "\"'`"}
_TRIPLE = {q: re.compile(rf"[\s\S]*?(?={q}|\Z)") for q in ('"""', "'''")}


def lexical_tokens(line: str) -> list[tuple[int, int, str, str]]:
    """(start, end, text, kind) with kind name, op, str, com, bare, pass, url, pem."""
    out: list[tuple[int, int, str, str]] = []
    at, n = 0, len(line)

    def inner(low: int, high: int, kind: str) -> None:
        for m in _INNER.finditer(line, low, high):
            if m["pass"] is not None:
                out.append((m.start(), m.end("url"), m["url"], "url"))
                out.append((m.start("pass"), m.end("pass"), m["pass"], "pass"))
            elif m["flag"]:
                out.append((m.start(), m.end(), m["flag"], "flag"))
            elif m["login"]:
                out.append((m.start(), m.end(), m["login"], "login"))
            elif m["chunk"]:
                low_, high_ = m.span()
                if kind == "com":
                    high_ -= len(m[0]) - len(m[0].rstrip(".:"))
                if high_ > low_:
                    out.append((low_, high_, line[low_:high_], kind))

    armour = _PEM.match(line)
    if armour and armour.end() == n:
        return [(0, n, armour["label"], "pem")]
    while at < n:
        m = _SEGMENT.search(line, at)
        if m is None:
            break
        kind, at = m.lastgroup, m.end()
        if kind == "pass":
            out.append((m.start(), m.end("url"), m["url"], "url"))
            out.append((m.start("pass"), m.end("pass"), m["pass"], "pass"))
        elif kind == "q":
            mark = m[0]
            body = (_TRIPLE[mark] if len(mark) == 3 else _QUOTED[mark]).match(line, at)
            inner(at, body.end(), "str")
            at = body.end() + len(mark)
        elif kind == "com":
            if m[0] == "--" or (m[0] == "#" and m.start() and not line[m.start() - 1].isspace()):
                continue
            inner(at, n, "com")
            at = n
        elif kind == "word":
            out.append((m.start(), m.end(), m[0], "flag" if m[0].endswith("=") else "name"))
        elif kind == "op":
            out.append((m.start(), m.end(), m[0], "op"))
            # A setting without quotes: the value runs to the end of the line or to a comment.
            if m[0] in (":", "=") and len(out) == 2 + (len(out) > 2 and out[0][2] == "-") and out[-2][3] in ("name", "str"):
                bare = re.compile(r"[ \t]*([^\s\"'`\[{(|>&*][^\s\"'`({]*)[ \t\r]*(?:$|#)").match(line, at)
                if bare and not re.fullmatch(r"-?\d+(?:\.\d+)?,?|true,?|false,?|null,?", bare[1]) and not bare[1].endswith((";", ",")):
                    out.append((bare.start(1), bare.end(1), bare[1], "bare"))
                    at = bare.end(1)
    return out


# --- features --------------------------------------------------------------------------------------------------------

# Words in the names of secrets, of what is no secret, and of things about secrets.
_SECRET_NAME = re.compile(r"(?:^|_)(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credentials?|creds?|api_?key|apikey|access_?key|private_?key|signing_?key|secret_?key|encryption_?key|master_?key|auth_?key|license_?key|account_?key|key|salt|pin|auth|authorization)(?:_(?:value|v?\d+|old|new|prod|dev|test|default))?$")
_PUBLIC_NAME = re.compile(r"(?:^|_)(?:commit|sha\d*|checksum|integrity|digest|hash|etag|uuid|guid|id|rev|revision|md5|fingerprint|icon|image|logo|svg|png|data|public_key|verify_key|pub_key|node|build|version|alphabet|charset|table|request_id|trace)(?:_\w{1,4})?$")
_ABOUT_NAME = re.compile(r"(?:^|_)(?:url|uri|hint|pattern|regex|name|field|column|label|length|len|size|path|file|env|var|prompt|message|msg|text|title|header_name|type|ttl|timeout|expiry|expires|count|policy|help|placeholder|example|limit|max|min|cookie|interval|seconds)$")
_LOOKUP = re.compile(r"(?i)(?:^|[._])(?:get_?env|environ|env|vault|secrets_?manager|keyring|get_?secret|read_?secret|config_?get)(?:[._]|$)")
_FIXED_FORM = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{12,}$|gh[pousr]_[A-Za-z0-9]{20,}$|github_pat_\w{20,}$|glpat-[\w-]{16,}$|xox[abprs]-[\w-]{10,}$|[srp]k_(?:live|test)_[A-Za-z0-9]{10,}$|AIza[\w-]{30,}$|SG\.[\w-]{10,}\.[\w-]{10,}$|npm_[A-Za-z0-9]{20,}$|ya29\.[\w-]{10,}$|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}$|hv[sb]\.[\w-]{16,}$|dop_v1_\w{20,}$|shpat_\w{20,}$|pypi-[\w-]{20,}$|AAAA[\w-]{5,}:[\w-]{20,}$")
_TAGGED = re.compile(r"[a-z]{2,5}(?:_(?:pat|live|test|key|sec|tok))?[_.-](?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{16,}$")
_PLACEHOLDER = re.compile(r"(?i)[x*.#•_-]{3,}$|<.*>$|\$?\{\{?.*\}\}?$|%\(?\w+\)?s?%?$|\$\w+$|(?:todo|fixme|tbd|none|null|nil|undefined|empty|changeme|change[-_]?me|changed?[-_].*|redacted|masked|hidden|secret|password|passwd|dummy|example|sample|placeholder|insert.*|your[-_ ].*|my[-_ ].*|replace.*|set[-_]?me.*|fill[-_]?me.*|not[-_]?set|n/a|test|foo|bar|string|value|token|default|@.*@|!\w+|vault:.*|env:.*|file:.*|arn:aws:secretsmanager.*|op://.*|ref\+.*)$|.*\*{4,}.*$|.*(?:x{6,}|X{6,}).*$")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_ESCAPES = re.compile(r"(?:\\(?:x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|.)){4}")
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")
_WORDS_NUMBER = re.compile(r"[A-Za-z]{3,}(?:[-_.][A-Za-z]{2,})+[-_.]?\d{1,4}$")
_CONSTANT = re.compile(r"_{0,2}[A-Z]+\d{0,3}(?:_[A-Z]+\d{0,4})+$")
_NAME_LIKE = re.compile(r"[A-Za-z_]+(?:[._-][A-Za-z_]+)*$")
_ADDRESS = re.compile(r"[a-z][\w+.-]*://|[./~]?/[\w./-]*$|[\w.-]+\.(?:example|com|org|net|io|dev|invalid|local)\b|data:|sha\d+-|[\w.+-]+@[\w-]+\.|\d+(?:\.\d+)*$|v\d")
_PARTS = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")


@functools.lru_cache(maxsize=20_000)
def name_class(name: str) -> str:
    """secret, public, about or plain."""
    snake = "_".join(_PARTS.findall(name.rpartition(".")[2].strip("-=[]"))).lower()
    if not snake:
        return "plain"
    if _ABOUT_NAME.search(snake):
        return "about"
    if _PUBLIC_NAME.search(snake) and not snake.endswith("secret_key"):
        return "public"
    return "secret" if _SECRET_NAME.search(snake) else "plain"


@functools.lru_cache(maxsize=50_000)
def shape(text: str) -> tuple[str, ...]:
    """Shape features of a token."""
    n = len(text)
    if _PLACEHOLDER.match(text):
        return ("placeholder",)
    if _FIXED_FORM.match(text):
        return ("fixed form",)
    if _UUID.match(text):
        return ("uuid",)
    if _HEX.match(text):
        return ("hex",)
    if _ESCAPES.match(text):
        return ("escapes",)
    if _ADDRESS.match(text):
        return ("address",)
    lower, upper, digit = (any(map(f, text)) for f in (str.islower, str.isupper, str.isdigit))
    classes = lower + upper + digit
    size = "short" if n < 8 else "middle" if n < 20 else "long"
    if _TAGGED.match(text):
        return ("tagged", size)
    if _CONSTANT.match(text):
        return ("name", size)
    if _WORDS_NUMBER.match(text):
        return ("words and number", size)
    if _NAME_LIKE.match(text.rstrip(".:!?")) and not digit:
        switches = sum(a.islower() != b.islower() for a, b in zip(text, text[1:], strict=False) if a.isalpha() and b.isalpha())
        if not (lower and upper and n >= 16 and switches > 0.45 * n):
            return ("name", size)
    if n >= 20 and classes == 3 and re.fullmatch(r"[A-Za-z0-9+/=_-]+", text):
        return ("mixed", size)
    if n >= 6 and digit and (lower or upper):
        return ("password" if re.search(r"[^A-Za-z0-9]", text) else "letters and digits", size)
    return (f"other{classes}", size)


#: Parts of the names of functions that are given secrets.
_USES = re.compile(r"(?i)sign|auth|log_?in|connect|session|credential|dial|unlock|decrypt|encrypt")


def pem_features(label: str) -> list[str]:
    """Features of a block in armour, which is one token, by the words of its label."""
    return ["kind pem", *(f"pem {word}" for word in label.split())]


def features(tokens: list[tuple[int, int, str, str]]) -> list[list[str]]:
    if len(tokens) == 1 and tokens[0][3] == "pem":
        return [pem_features(tokens[0][2])]
    out = []
    key, key_class, lead, called, callee = "", "none", "", "", ""
    per_literal: dict[int, int] = {}
    for i, (_, _, _, kind) in enumerate(tokens):
        if kind in ("str", "com"):
            j = i
            while j and tokens[j - 1][3] == kind and tokens[j][0] - tokens[j - 1][1] <= 2:
                j -= 1
            per_literal[j] = per_literal.get(j, 0) + 1
            per_literal[-i - 1] = j
    for i, (_, _, text, kind) in enumerate(tokens):
        if kind in ("name", "op", "url", "flag", "login"):
            out.append([f"kind {kind}"])
            if kind == "name" or kind == "flag":
                # Short names of minified code say nothing.
                named = name_class(text) if len(text.rpartition(".")[2]) > 3 or tokens[-1][1] < 400 else "plain"
                follows, leads = tokens[i + 1][2] if i + 1 < len(tokens) else "", tokens[i - 1][2] if i else "{"
                if follows in (":", "=", ":=") and leads in ("{", ",", "("):
                    key, key_class = text, named  # the next key of a list of keys
                if kind == "flag" or named != "plain" or i == 0 or tokens[i - 1][3] != "op" or tokens[i - 1][2] in "([,{":
                    if kind == "flag" or named != "plain" or key_class in ("none", "plain"):
                        key, key_class = text, named
                lead = text if kind == "flag" else ""
                if follows == "(":
                    callee = "uses" if _USES.search(text) else "other"
                called = "env" if _LOOKUP.search(text) else called if kind == "flag" else ""
            elif kind == "login":
                lead = "login"
            elif kind == "op" and text == ",":
                pass
            continue
        form = shape(text)
        what = form[0]
        row = [f"kind {kind}", f"shape {what}", f"shape {what} {kind}", f"shape {what} key {key_class}"]
        if len(form) > 1:
            row.append(f"shape {what} {form[1]}")
        words = per_literal.get(per_literal.get(-i - 1, -1), 1)
        alone = "alone" if words == 1 else "few" if words < 4 else "many"
        row.append(f"{alone} {kind}")
        row.append(f"{alone} key {key_class} shape {what}")
        before = tokens[i - 1][2].lower() if i else ""
        if before == "[" and kind == "str":
            row.append("subscript")
        if before in ("bearer", "basic", "token", "was", "is"):
            row += [f"after {before}", f"after {before} shape {what}"]
        if called:
            row.append(f"call {called}")
        if callee and kind == "str":
            row += [f"given to {callee}", f"given to {callee} {alone} shape {what}"]
        if what == "name" and len(text) < 40:
            row.append(f"names {name_class(text)} {'-' if '-' in text else '_' if '_' in text else 'one'} key {key_class}")
        if lead:
            row.append(f"flag {name_class(lead) if lead != 'login' else 'login'} shape {what}")
        if i and tokens[i - 1][3] == "op" and tokens[i - 1][2] == "+":
            row.append("joined")
        if kind == "pass":
            row.append(f"login shape {what}")
        out.append(row)
        lead = ""
        if kind in ("str", "bare") and words == 1:
            named = name_class(text) if len(text) < 40 and what in ("name", "other1", "other2", "placeholder") and _NAME_LIKE.match(text) else "plain"
            if named in ("secret", "public", "about"):
                key, key_class = text, named
    return out


# --- the field -------------------------------------------------------------------------------------------------------


class Field:
    """A linear chain with the labels 0 (other) and 1 (secret)."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        score = self.scores(rows)
        (a, b), (c, d) = self.step
        best0, best1, back = 0.0, score[0] if score else 0.0, []
        for s in score[1:]:
            from0, from1 = best0 >= best1 + c - a, best0 + b > best1 + d
            back.append((0 if from0 else 1, 0 if from1 else 1))
            best0, best1 = (best0 + a if from0 else best1 + c), (best0 + b if from1 else best1 + d) + s
        label = int(best1 > best0)
        path = [label]
        for pair in reversed(back):
            label = pair[label]
            path.append(label)
        return path[::-1] if score else []

    def fit(self, data: list[tuple[list[list[str]], list[int]]], seed: int = 7) -> Field:
        """Stochastic gradient ascent with per-weight rates on the log likelihood."""
        chance, seen = random.Random(seed), {}
        step_seen = [[1.0, 1.0], [1.0, 1.0]]
        for _ in range(EPOCHS):
            chance.shuffle(data)
            for rows, gold in data:
                n = len(rows)
                if not n:
                    continue
                score, t = self.scores(rows), self.step
                fore = [(0.0, score[0])]
                for s in score[1:]:
                    p, q = fore[-1]
                    fore.append((_plus(p + t[0][0], q + t[1][0]), _plus(p + t[0][1], q + t[1][1]) + s))
                back = [(0.0, 0.0)] * n
                for i in range(n - 2, -1, -1):
                    p, q = back[i + 1]
                    s = score[i + 1]
                    back[i] = (_plus(t[0][0] + p, t[0][1] + s + q), _plus(t[1][0] + p, t[1][1] + s + q))
                whole = _plus(*fore[-1])
                for i, row in enumerate(rows):
                    gradient = gold[i] - math.exp(min(0.0, fore[i][1] + back[i][1] - whole))
                    if abs(gradient) > 1e-3:
                        for f in row:
                            g = seen[f] = seen.get(f, 1e-2) + gradient * gradient
                            w = self.weight.get(f, 0.0)
                            self.weight[f] = w + RATE * (gradient - PENALTY * w) / math.sqrt(g)
                    if i:
                        for x in (0, 1):
                            for y in (0, 1):
                                chance_xy = math.exp(min(0.0, fore[i - 1][x] + t[x][y] + (score[i] if y else 0.0) + back[i][y] - whole))
                                g = (gold[i - 1] == x and gold[i] == y) - chance_xy
                                step_seen[x][y] += g * g
                                t[x][y] += 0.1 * RATE * g / math.sqrt(step_seen[x][y])
        return self


def _plus(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high)) if low - high > -40 else high


# --- generated lines for training ------------------------------------------------------------------------------------

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SOME_WORDS = "apple basil candle daisy engine forest garden hammer island jacket kettle ladder mirror needle orange pencil quarry rabbit saddle tunnel urchin velvet window yellow zephyr".split()


def _secret_value(r: random.Random) -> str:
    some = lambda k, alphabet=_ALNUM: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: r.choice(_SOME_WORDS)
    return r.choice(
        [
            lambda: "AKIA" + some(16, _ALNUM[:26] + "234567"),
            lambda: "ghp_" + some(36),
            lambda: f"xoxb-{some(11, '0123456789')}-{some(24)}",
            lambda: "sk_live_" + some(26),
            lambda: f"eyJ{some(30)}.eyJ{some(40)}.{some(42, _ALNUM + '-_')}",
            lambda: r.choice(["tk.", "qa_pat_", "orb_", "zed_", "key-"]) + some(r.randint(20, 40)),
            lambda: some(40, "0123456789abcdef"),
            lambda: some(32, "0123456789abcdef"),
            lambda: "-".join(some(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12)),
            lambda: some(r.choice([32, 43, 44]), _ALNUM + "+/") + r.choice(["", "="]),
            lambda: some(r.randint(12, 40), _ALNUM + "-_"),
            lambda: some(r.randint(10, 30)),
            lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 99)}",
            lambda: f"{word().title()}{r.choice('!#*_@$%')}{word()}{r.randint(10, 99)}",
            lambda: f"{r.randint(1960, 2030)}{word().title()}_{word()}",
            lambda: some(3, _ALNUM[:26]) + some(4, _ALNUM[26:52]) + str(r.randint(0, 9)) + r.choice("!*_#") + some(3),
            lambda: some(r.randint(8, 16), _ALNUM + "!*_-#"),
        ]
    )()


def training_lines(count: int = TRAIN_LINES, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the spans of their secrets; all values are drawn at random."""
    r = random.Random(seed)
    word = lambda: r.choice(_SOME_WORDS)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    secret_names = ["password", "db_password", "passwd", "pwd", "api_key", "apiKey", "API_KEY", "secret", "clientSecret", "client_secret", "auth_token", "accessToken", "ACCESS_TOKEN", "private_token", "signing_key", "signingKey", "smtp_pass", "webhookSecret", "license_secret", "adminPw", "ADMIN_PW", "encryption_key", "store.secretKey", "AUTH_TOKEN", "PASSWD", "DB_PASSWORD"]
    plain_names = ["value", "header", "args", "remote", "conn", "hdr", "endpointCfg", "legacy_value", "OPTS_TAIL", "k1", "broker", "target", "VALUE_A", "label", "mode", "title", "description"]
    public_names = ["commit", "checksum", "integrity", "NODE_ID", "requestId", "etag", "build_hash", "digest", "trace_id", "rev", "sha256", "uuid"]
    about_names = ["password_hint", "secretName", "token_field", "PASSWORD_COLUMN", "secret_pattern", "token_url", "password_label", "keyPath", "token_type", "passwordPrompt"]
    uses = ["sign_request", "signRequest", "connect", "openSession", "login", "authenticate", "auth_client", "dial", "open_session", "createSession"]
    placeholders = ["", "xxxx", "********", "TODO", "<API_KEY>", "<insert password>", "${SECRET}", "{{ vault.token }}", "changed-at-deploy", "changeme", "REDACTED", "<from vault>", "${DB_PASSWORD}", "xxxxxxxxxxxxxxxx", "your-api-key", "example", "not-set", "dummy"]

    def assign(name: str, value: str) -> str:
        return r.choice(['{n} = "{v}"', 'const {n} = "{v}";', 'let {n}: &str = "{v}";', 'private static final String {n} = "{v}";', "{n}: {v}", '{n}: "{v}"', '"{n}": "{v}",', "{n} := `{v}`", "{n} = '{v}'", 'put("{n}", "{v}");', 'set_option("{n}", "{v}")', 'static const char *{n} = "{v}";', 'export const {n}: string = "{v}";', 'config["{n}"] = "{v}"', '    {n}="{v}",']).format(n=name, v=value)

    out = []
    for _ in range(count):
        v, kind = _secret_value(r), r.random()
        secrets = [v]
        if kind < 0.24:
            line = assign(r.choice(secret_names), v)
        elif kind < 0.30:
            use, form = r.choice(uses), r.random()
            while form < 0.5 and not (_FIXED_FORM.match(v) or _TAGGED.match(v)):
                v = _secret_value(r)
            while form >= 0.5 and (_UUID.match(v) or _HEX.match(v)):
                v = _secret_value(r)
            secrets = [v]
            line = r.choice([lambda: assign(r.choice(plain_names), v), lambda: f"# {word()} {v} {word()}"] if form < 0.5 else [lambda: f'{use}("{word()}", "{v}", {r.randint(1, 999)});', lambda: f'{use}("{word()}.db.example", "svc_{word()}", "{v}")', lambda: f"// old key was {v}, remove after the move", lambda: f"# the old token was {v}", lambda: f"// {word()} with mysql -u{word()} -p{v.replace('-', 'x').replace(' ', '')}"])()
            secrets = [v] if v in line else [v.replace("-", "x")]
        elif kind < 0.31:
            v = "-----BEGIN " + r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----"
            secrets, line = [v], v
        elif kind < 0.40:
            line = r.choice(['h.set("Authorization", "{s} {v}")', 'setHeader("Proxy-Authorization", "{s} {v}");', 'args: "{s} {v}"', '"header": "{s} {v}",', "// send {s} {v}"]).format(s=r.choice(["Bearer", "Bearer", "Basic"]), v=v)
        elif kind < 0.50:
            line = r.choice(['cmd = "dump --host=a.example --user=b --password={v} {w}"', 'value: "--token={v}"', 'args = "pw={v}"', '// pw={v} until the vault is ready', '"args": "--api-key={v}"', "# password={v}", 'const c = "curl -s -u svc_{w}:{v} https://a.example/h";']).format(v=v, w=word())
        elif kind < 0.58:
            line = assign(r.choice(plain_names), f"{r.choice(['postgres', 'amqp', 'redis', 'mongodb', 'https'])}://svc_{word()}:{v.replace('/', '')}@{word()}.example:{r.randint(1000, 9999)}/{word()}")
            secrets = [v.replace("/", "")]
        elif kind < 0.63 and len(v) > 11:
            cut = r.randint(5, len(v) - 5)
            secrets = [v[:cut], v[cut:]]
            line = f'{r.choice(["const ", "", "String "])}{r.choice(secret_names)} = "{v[:cut]}" + "{v[cut:]}"{r.choice([";", ""])}'
        else:
            secrets = []
            line = r.choice(
                [
                    lambda: assign(r.choice(secret_names), r.choice(placeholders)),
                    lambda: assign(r.choice(secret_names), r.choice(placeholders)),
                    lambda: assign(r.choice(secret_names), r.choice([f"{word()}_{word()}_token", f"{word()}_key", f"{word()}_secret", f"x-{word()}-token", f"{word()}Token"])),
                    lambda: f'{r.choice(uses)}("{word()}", "{word()}", {r.choice(secret_names)})',
                    lambda: f'{r.choice(uses)}("{word()}.db.example", {r.randint(1, 9999)}, "{word()}_{word()}")',
                    lambda: f'{r.choice([chr(34) * 3, chr(39) * 3, chr(34)])}{word().title()}{r.choice([".", "!", ""])}{r.choice(["", " " + word() + "."])}',
                    lambda: f"{word()} = {word()}.add(b'" + "".join(f"\\x{r.randint(0, 255):02x}" for _ in range(r.randint(6, 40))) + "')",
                    lambda: assign(r.choice(plain_names), "".join(word().title() for _ in range(r.randint(2, 5))) + r.choice(["", "Seconds", "Token", "Name", "Url"])),
                    lambda: f"// {word()} with ssh -p{r.randint(100000, 999999)}",
                    lambda: r.choice(["-----BEGIN PUBLIC KEY-----", "-----BEGIN RSA PUBLIC KEY-----", "-----BEGIN CERTIFICATE-----", "-----BEGIN CERTIFICATE REQUEST-----"]),
                    lambda: r.choice(['{n} = os.environ["{u}"]', 'String {n} = System.getenv("{u}");', "const {n} = process.env.{u};", '{n} := os.Getenv("{u}")', 'let {n} = env::var("{u}");', "{n} = vault.read(\"{w}/{w}\")"]).format(n=r.choice(secret_names), u=r.choice(secret_names).upper(), w=word()),
                    lambda: assign(r.choice(public_names), r.choice([hexes(40), hexes(64), hexes(32), "-".join(map(hexes, (8, 4, 4, 4, 12))), "sha512-" + v])),
                    lambda: assign(r.choice(about_names), r.choice(["access_token", "user.password", "client_secret", "wrong password or token expired", "enter the api key from your profile", f"https://{word()}.example/oauth/token", "(api|auth)_(key|token)=[A-Za-z0-9]{20,}", "password must have 12 characters"])),
                    lambda: f'h.set("Authorization", "{r.choice(["Bearer <token>", "Bearer ${TOKEN}", "Basic REDACTED", "Bearer {token}"])}")',
                    lambda: assign(r.choice(plain_names), r.choice([f"{word()} {word()}", f"{word()}-{word()}", f"{word().title()}{word().title()}", f"{word()} panel {r.randint(1, 99)}", "AccessTokenRefreshIntervalSeconds", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", hexes(40), "data:image/png;base64," + "".join(r.choice(_ALNUM) for _ in range(120))])),
                    lambda: assign(r.choice(plain_names), f"postgres://svc:{r.choice(['****', '${DB_PASS}', '<password>', '{pw}'])}@{word()}.example:5432/{word()}"),
                    lambda: r.choice(["// the token comes from the vault, see ops notes", "# secret = value of the mounted file", "// rotate api_key every 90 days", "// never log the password here", f"// checksum {hexes(64)}", f"# commit {hexes(40)}", f"// see {word()}-{word()}-{r.randint(10, 99)} for the key", f"/* {word()} {r.randint(1, 99)} */"]),
                    lambda: f"{word()}_{word()} = {word()}({word()}, {r.randint(1, 999)})",
                    lambda: f"_{word()}['_{word().upper()}_F{r.randint(0, 99)}']._{word()}_start={r.randint(1, 9999)}",
                    lambda: f'{word()}["{word()}{r.randint(1, 99)}"] = {word()}["{word()}_{word()}"] + {r.randint(1, 9)}',
                    lambda: f"{word()} = sorted({word()}, key=lambda item: (item[0], -{r.randint(1, 999)}))",
                    lambda: f'{word()}.put("{word()}", "{word()}{r.randint(1, 99)}");',
                    lambda: f"'{''.join(r.choice(_ALNUM + '+/') for _ in range(76))}'",
                    lambda: f'"node_modules/{word()}-{hexes(4)}": {{',
                ]
            )()
        spans, at = [], 0
        for part in secrets:
            low = line.index(part, at)
            spans.append((low, low + len(part)))
            at = low + len(part)
        out.append((line, spans))
    return out


@functools.lru_cache(maxsize=1)
def trained_field() -> Field:
    data = []
    for line, spans in training_lines():
        tokens = lexical_tokens(line)
        data.append((features(tokens), [int(any(a < high and low < b for a, b in spans)) for low, high, _, _ in tokens]))
    return Field().fit(data)


# --- code ------------------------------------------------------------------------------------------------------------


class Finder:
    """Labels the lines of code that hold a literal, a comment, a setting or a flag."""

    def __init__(self, field: Field):
        self.field, self.cache = field, {}

    def candidates(self, code: str) -> list[int]:
        """Places of literals, comments, settings and flags; a line without any has no token that the field could label."""
        return [m.start() for m in _HOLDS.finditer(code)]

    def in_line(self, line: str) -> tuple[tuple[int, int], ...]:
        """Spans of secrets in a (logical) line; equal lines are labelled once."""
        known = self.cache.get(line)
        if known is None:
            tokens = lexical_tokens(line)
            labels = self.field.viterbi(features(tokens))
            known = tuple((t[0], t[1]) for t, y in zip(tokens, labels, strict=True) if y and t[3] not in ("name", "op", "url", "flag", "login"))
            if len(self.cache) > CACHE_LINES:
                self.cache.clear()
            self.cache[line] = known
        return known

    def in_code(self, code: str) -> list[list[tuple[int, int]]]:
        """Each secret as its parts, as spans of the code."""
        out: list[list[tuple[int, int]]] = []
        blocks = []
        for m in _PEM.finditer(code) if "-----BEGIN " in code else ():
            blocks.append(m.span())
            if m["body"].strip(" \\rn\n-") and self.field.viterbi([pem_features(m["label"])])[0]:
                out.append([m.span()])
        done = 0
        for place in self.candidates(code):
            if place < done:
                continue
            low = max(code.rfind("\n", 0, place) + 1, done)
            high = code.find("\n", place)
            high = len(code) if high < 0 else high
            # A value in parts: the next line goes on with a literal.
            while high < len(code):
                tail = code[low:high].rstrip(" \t\r")
                following = code[high + 1 : high + 160].lstrip(" \t")
                if not (tail.endswith(("+", "\\", "(", "=", ".")) and following[:1] in "\"'`+" or tail.endswith(('"', "'")) and following[:2] in ('+ "', "+ '")) and not (tail.endswith(('"', "'")) and following[:1] in "\"'" and re.search(r"=\s*\(?\s*[\"'\n]", tail) and ":" not in following.split("\n")[0]):
                    break
                following_end = code.find("\n", high + 1)
                high = len(code) if following_end < 0 else following_end
            done = high
            parts: list[tuple[int, int]] = []
            for a, b in self.in_line(code[low:high]):
                span = (low + a, low + b)
                if any(x < span[1] and span[0] < y for x, y in blocks):
                    continue
                if parts and not re.fullmatch(r"[\"'`\s+\\().]*", code[parts[-1][1] : span[0]]):
                    out.append(parts)
                    parts = []
                parts.append(span)
            if parts:
                out.append(parts)
        return sorted(out)


def redact(code: str, secrets: list[list[tuple[int, int]]]) -> str:
    """The code with each part of each secret replaced by a word that is valid in any literal or comment."""
    out, at = [], 0
    for low, high in sorted(span for parts in secrets for span in parts):
        if low < at:
            continue
        out += [code[at:low], REDACTED]
        at = high
    out.append(code[at:])
    return "".join(out)


def find_secrets(elements: DataFrame) -> DataFrame:
    """(id, line_nos, code): the lines (from 1, split at line feeds) on which secrets begin, and the redacted code.

    One row for each input row that holds a secret; rows with null or empty code and rows of the type
    documentation hold none. Repeated rows give the same row again. Everything but the secrets' characters is
    unchanged.
    """

    field = elements.sparkSession.sparkContext.broadcast(trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field.value)
        for batch in batches:
            rows, lines, codes = [], [], []
            for row, code in enumerate(batch.column(1).to_pylist()):
                found = finder.in_code(code)
                if found:
                    rows.append(row)
                    lines.append(sorted({code.count("\n", 0, parts[0][0]) + 1 for parts in found}))
                    codes.append(redact(code, found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.list_(pa.int32())), pa.array(codes, pa.string())], names=["id", "line_nos", "code"])

    code_rows = elements.where(F.coalesce(F.col("type"), F.lit("")) != "documentation").where("code is not null and code <> ''")
    return code_rows.select("id", "code").mapInArrow(run, "id string, line_nos array<int>, code string")
