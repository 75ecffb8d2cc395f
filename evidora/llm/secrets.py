"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field on top.

The field tags tokens as begin, inside or outside of a secret. Features are a token's shape (length,
kinds of characters and how they alternate, known prefixes, whether it falls into words), the words before it (a telling word, a
sign of assignment) and the whole file (how many odd tokens and assignments it has). Its weights
are fitted here on texts that ``sample_texts`` makes by rule, once in a process; decoding is Viterbi's.

Every token has a shape. That of most is plain: pieces (between marks) of letters in usual case or of digits alone. All
plain tokens without a telling word close before have the same emission, so that a text without any other token is tagged outside
throughout; ``Field.check`` makes sure of that for the fitted weights, and such texts need no decoding.

Spans are in code points, the end exclusive. A span of the field is kept if it doesn't overlap one of
the patterns. Defined cases: null or empty text has no span; the digest of no spans is that of the
empty string; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[A-Za-z0-9+/_.~-]+={0,2}|[^\sA-Za-z0-9+/_.~-]+")
_DIGIT = re.compile(r"[0-9]")
_LONG = re.compile(r"[A-Za-z0-9+/_.=~-]{8,}")
#: Pieces of letters in usual case, of digits, or of neither.
_USUAL = re.compile(r"[+/_.=~-]*+(?:(?:[A-Z]?[a-z]{1,27}|[A-Z]{1,15}|[0-9]++)(?:[+/_.=~-]++|\Z))*+")
_CAMEL = re.compile(r"[a-z]{0,12}(?:[A-Z][a-z]{2,14}){1,6}")
_PIECES = re.compile(r"[A-Za-z0-9]+")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}", re.I)
_TELLING = re.compile(r"pass(?:word|wd|phrase)?s?|pwd|secrets?|tokens?|api|key|keys|apikey|credentials?|bearer|authorization|auth|private", re.I)
_TELLING_IN = re.compile(r"pass|pwd|secret|token|key|credential|bearer|auth|private", re.I)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk-", "sk_live", "pk_live", "rk_live", "xox", "AIza", "eyJ", "glpat-", "npm_", "SG.", "hf_", "ya29.", "dop_v1", "shpat_")
O, B, I = 0, 1, 2
NEAR = 4
SHAPES = ["plain", "odd", "len8", "len12", "len16", "len20", "len28", "len36", "len48", "digits", "hex", "hex_short", "lower_digit", "upper_digit", "mixed", "mixed_letters", "letters", "turns_few", "turns_some", "turns_many", "words", "camel", "consonants", "dots", "dashes", "dashes4", "slashes", "equals_end", "underscore", "prefix", "uuid", "date", "vowels", "telling", "telling_near", "telling_odd", "telling_before", "sign_before", "sign_near", "quote_before", "file_many", "file_signs", "after_odd"]
_AT = {name: i for i, name in enumerate(SHAPES)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _DIGIT.search(text) or len(text) >= 32:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _turns(token: str) -> int:
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in token]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def is_odd(token: str) -> bool:
    """Whether a token of eight or more characters isn't plain."""
    return len(token) >= 8 and _USUAL.fullmatch(token) is None


@functools.lru_cache(maxsize=16_384)
def shape(token: str) -> tuple[str, ...]:
    """Names of the features of a token's own characters."""
    n, out = len(token), ["odd" if is_odd(token) else "plain"]
    if n >= 8:
        out.append(next(f"len{k}" for k in (48, 36, 28, 20, 16, 12, 8) if n >= k))
    core = token.strip("=.-_")
    digits, upper, lower = any(c.isdigit() for c in core), any(c.isupper() for c in core), any(c.islower() for c in core)
    pieces = _PIECES.findall(core)
    camel = bool(pieces) and all(_CAMEL.fullmatch(p) or _USUAL.fullmatch(p) for p in pieces)
    share = _turns(core) / max(1, len(core))
    hexed = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core or "x"))
    out += [name for name, yes in (
        ("digits", bool(core) and not core.strip("0123456789.-/+")), ("hex", hexed), ("hex_short", hexed and n < 28),
        ("lower_digit", digits and lower and not upper), ("upper_digit", digits and upper and not lower), ("mixed", digits and upper and lower),
        ("letters", not digits), ("mixed_letters", not digits and upper and lower and not camel), ("turns_many", share > 0.35), ("turns_some", 0.15 < share <= 0.35), ("turns_few", share <= 0.15),
        ("words", bool(pieces) and max(map(len, pieces)) <= 14 and all(re.fullmatch(r"[A-Z]?[a-z]+\d{0,4}|[A-Z]+\d{0,4}|\d{1,6}", p) for p in pieces)), ("camel", camel), ("consonants", bool(_CONSONANTS.search(core))),
        ("dots", core.count(".") > 1), ("dashes", "-" in core), ("dashes4", core.count("-") > 3), ("slashes", core.count("/") > 1), ("equals_end", token.endswith("=") and n > 16), ("underscore", "_" in core),
        ("prefix", token.startswith(PREFIXES)), ("uuid", bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", core))), ("date", bool(re.match(r"(19|20)\d\d[-/.]\d\d|\d\d[-/.]\d\d[-/.]", core))), ("vowels", sum(c in "aeiouAEIOU" for c in core) > 0.3 * max(1, len(core))),
    ) if yes]
    return tuple(out)


@functools.lru_cache(maxsize=16_384)
def _tells(token: str) -> bool:
    return 3 <= len(token) <= 24 and bool(_TELLING_IN.search(token)) and any(_TELLING.fullmatch(p) for p in re.split(r"[_.=-]", token))


def rows_of(text: str) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """Places of all tokens, and the features of those that aren't plain or follow a telling word."""
    matches = list(_TOKEN.finditer(text))
    tokens = [m[0] for m in matches]
    odd = {i for i, t in enumerate(tokens) if len(t) >= 8 and is_odd(t)}
    telling = {i for i, t in enumerate(tokens) if _tells(t) and i not in odd} if _TELLING_IN.search(text) else set()
    near = {j for i in telling for j in range(i + 1, min(i + 1 + NEAR, len(tokens))) if len(tokens[j]) >= 6}
    signs = sum(t in ("=", ":", "=>", ":=") for t in tokens) if odd or near else 0
    found = {}
    for i in sorted(odd | near):
        names = list(shape(tokens[i]))
        before = tokens[max(0, i - NEAR) : i]
        if any(k in telling for k in range(max(0, i - NEAR), i)):
            names.append("telling_near")
            if i in odd:
                names.append("telling_odd")
        if i - 1 in telling:
            names.append("telling_before")
        if i in near and i not in odd:
            names.append("telling")
        sign = [t.strip("\"'`") in ("=", ":", "=>", ":=") or t[-1] == "=" or t in ('":', "':", '="', "='") for t in before]
        if sign and sign[-1]:
            names.append("sign_before")
        if any(sign[-2:]):
            names.append("sign_near")
        if before and before[-1][-1:] in "\"'`":
            names.append("quote_before")
        if len(odd) > 20:
            names.append("file_many")
        if signs > 5:
            names.append("file_signs")
        if i - 1 in odd:
            names.append("after_odd")
        found[i] = [_AT[x] for x in names]
    return [m.span() for m in matches], found


class Field:
    """Weights and decoding. ``weights``: features by tags; ``moves``: from tag to tag; a secret never begins inside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self._w, self._m = weights.tolist(), moves.tolist()
        self._plain = self._w[_AT["plain"]]

    def check(self) -> None:
        """Plain tokens alone are outside, whatever their number: no way round through B or I pays."""
        m, e = self.moves, self.weights[_AT["plain"]]
        stay = e[O] + m[O, O]
        loss_in, gain = stay - e[I] - m[I, I], m[O, B] + e[B] + max(m[B, O], m[B, I] + e[I] + m[I, O] - stay) - (e[O] + 2 * m[O, O])
        if not (gain < 0 and loss_in > 0 and stay - e[B] - m[B, B] > 0):
            raise ValueError("plain tokens aren't safely outside under these weights")

    def emission(self, features: list[int] | None) -> list[float]:
        """Scores of the three tags of a token with these features; None: of a plain one."""
        if features is None:
            return self._plain
        return [sum(self._w[x][t] for x in features) for t in (O, B, I)]

    def tag(self, n: int, found: dict[int, list[int]]) -> list[int]:
        """Viterbi over n tokens."""
        w, m, plain = self._w, self._m, self._plain
        o, b, i = 0.0, -math.inf, -math.inf
        back = []
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = m
        for k in range(n):
            if (f := found.get(k)) is None:
                eo, eb, ei = plain
            else:
                eo = eb = ei = 0.0
                for x in f:
                    row = w[x]
                    eo += row[0]
                    eb += row[1]
                    ei += row[2]
            a0, a1, a2 = o + oo, b + bo, i + io
            no, po = (a0, O) if a0 >= a1 and a0 >= a2 else (a1, B) if a1 >= a2 else (a2, I)
            a0, a1, a2 = o + ob, b + bb, i + ib
            nb, pb = (a0, O) if a0 >= a1 and a0 >= a2 else (a1, B) if a1 >= a2 else (a2, I)
            a1, a2 = b + bi, i + ii
            ni, pi = (a1, B) if a1 >= a2 else (a2, I)
            o, b, i = no + eo, nb + eb, ni + ei
            back.append((po, pb, pi))
        t = O if o >= b and o >= i else B if b >= i else I
        out = []
        for step in reversed(back):
            out.append(t)
            t = step[t]
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        places, found = rows_of(text)
        if not found:
            return []
        out: list[list[int]] = []
        for (a, z), t in zip(places, self.tag(len(places), found)):
            if t == B or t == I and not out:
                out.append([a, z])
            elif t == I:
                out[-1][1] = z
        return [(a, z) for a, z in out]


def worth_decoding(text: str) -> bool:
    """Whether the text can hold a token that isn't plain, or a telling word."""
    return bool(_TELLING_IN.search(text)) or any(_USUAL.fullmatch(m) is None for m in _LONG.findall(text))


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end)."""
    base = base_spans(text)
    more = []
    if worth_decoding(text):
        for a, z in field.spans(text):
            if not any(a < e and s < z for s, _, e in base):
                more.append((a, 3, z))
    return base, sorted(base + more)


def sample_texts(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up texts with the places of their secrets."""
    r = random.Random(seed)
    some = lambda alphabet, low, high: "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = "ka lo mi ren tas vor el un shi der qua est bri no pel tion ing heit".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))

    def name(kind: str) -> str:
        parts = [word()[:12] for _ in range(r.randint(2, 5))]
        return {"camel": r.choice([str, str.capitalize])(parts[0]) + "".join(p.capitalize() for p in parts[1:]), "snake": "_".join(parts) + r.choice(["", str(r.randint(1, 99))]), "kebab": "-".join(parts), "const": "_".join(parts).upper()}[kind]

    def secret() -> str:
        return r.choice([
            lambda: "ghp_" + some(low + up + dig, 36, 36), lambda: "sk-" + some(low + up + dig, 32, 48), lambda: "sk_live_" + some(low + up + dig, 24, 30),
            lambda: "AKIA" + some(up + dig, 16, 16), lambda: "AIza" + some(low + up + dig + "-_", 35, 35), lambda: "xoxb-" + some(dig, 11, 13) + "-" + some(low + up + dig, 24, 24),
            lambda: "eyJ" + some(low + up + dig, 17, 33) + "." + some(low + up + dig + "-_", 30, 60) + "." + some(low + up + dig + "-_", 30, 43), lambda: "glpat-" + some(low + up + dig + "-_", 20, 20),
            lambda: some(low + up + dig + "+/", 28, 64) + r.choice(["", "=", "=="]), lambda: some(low + up + dig, 20, 44), lambda: some(low + up, 24, 44), lambda: "npm_" + some(low + up + dig, 36, 36), lambda: "hf_" + some(low + up, 34, 34), lambda: some("0123456789abcdef", 32, 64), lambda: some("0123456789ABCDEF", 32, 64), lambda: some(low + up + dig + "_-", 24, 40),
        ])()

    def benign() -> str:
        return r.choice([
            lambda: some(dig, 8, 19), lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: f"20{some(dig, 2, 2)}-{some(dig, 2, 2)}-{some(dig, 2, 2)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
            lambda: f"{word()}{r.randint(1, 99)}@{word()}.example.com", lambda: f"https://{word()}.example.org/{word()}/{r.randint(1, 99999)}", lambda: f"{word()}-{word()}-{r.randint(1, 999)}", lambda: f"{word()}_{word()}{r.randint(0, 99)}",
            lambda: f"v{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{word()}", lambda: some("0123456789abcdef", 8, 8) + "-" + "-".join(some("0123456789abcdef", 4, 4) for _ in range(3)) + "-" + some("0123456789abcdef", 12, 12),
            lambda: f"+{r.randint(1, 99)}{some(dig, 8, 10)}", lambda: f"{word()}{r.randint(1900, 2030)}", lambda: some("0123456789abcdef", 7, 20), lambda: name("camel"), lambda: name("snake"), lambda: name("kebab"), lambda: name("const"), lambda: "/".join(["src", *(word() for _ in range(r.randint(1, 4)))]) + r.choice(["/", "."]) + name("camel") + r.choice([".py", ".java", ".ts", ""]), lambda: f"{some(up, 2, 3)}-{some(dig, 3, 6)}-{some(up, 1, 2)}", lambda: f"{name('camel')}.{name('camel')}({word()})", lambda: f"{r.randint(1, 9)}{some(up, 1, 1)}{some(dig, 3, 5)}", lambda: word() + "-" + str(r.randint(1, 99)) + "." + word() + ".internal", lambda: f"https://www.{word()}.example.net/~{word()}/{word()}/{word()}-{word()}.html#{word()}-{r.randint(1, 9)}", lambda: f"({r.randint(100, 999)})", lambda: word() + word() + word() + str(r.randint(1, 9)), lambda: f"DE{some(dig, 18, 20)}", lambda: f"{r.randint(1, 9)},{some(dig, 3, 3)},{some(dig, 3, 3)}",
        ])()

    telling = ["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "client_secret", "auth_token", "private_key", "Authorization: Bearer", "access_key", "credentials", "Password", "SECRET_KEY"]
    out = []
    for _ in range(n):
        text, places = "", []
        for _ in range(r.randint(1, 5)):
            text += " ".join(word() + r.choice(["", "", "", ",", ".", "###", " |"]) for _ in range(r.randint(0, 12))) + " "
            x = r.random()
            if x < 0.25:
                text += r.choice(telling) + r.choice(["=", ": ", " = ", ' = "', ":'", " ", " is ", '": "', ' "', " for it is "])
                s = secret() if r.random() < 0.75 else some(low + up + dig + "_-", 8, 16) + r.choice(dig) + r.choice(low + up)
                places.append((len(text), len(text) + len(s)))
                text += s + r.choice(["", '"', "'", "", ";"])
            elif x < 0.45:
                s = secret()
                places.append((len(text), len(text) + len(s)))
                text += s
            elif x < 0.5:  # a secret within an address
                s, before = secret(), f"https://{word()}:"
                places.append((len(text) + len(before), len(text) + len(before) + len(s)))
                text += before + s + f"@{word()}.example.com/{word()}"
            elif x < 0.8:
                text += r.choice(["", "", word() + " = ", word() + ": ", "id="]) .replace("id=", "id= ") + benign()
            elif x < 0.88:
                text += r.choice(telling).split(":")[0] + " " + " ".join(word() for _ in range(5))
            text += r.choice([" ", "\n"])
        out.append((text, places))
    return out


@functools.lru_cache(maxsize=2)
def train(n: int = 1500, seed: int = 11, rounds: int = 150, ridge: float = 2e-4) -> Field:
    """Maximum likelihood by Adam on made-up texts; deterministic, and done once in a process."""
    kinds: dict[tuple[int, ...], int] = {}
    seqs = []
    for text, secrets_at in sample_texts(n, seed):
        spots, found = rows_of(text)
        if not spots:
            continue
        tags = [O] * len(spots)
        for a, z in secrets_at:
            inside = [i for i, (s, e) in enumerate(spots) if s < z and a < e]
            for k, i in enumerate(inside):
                tags[i] = I if k else B
        seqs.append(([kinds.setdefault(tuple(found.get(i, (_AT["plain"],))), len(kinds)) for i in range(len(spots))], tags))
    seqs.sort(key=lambda x: -len(x[1]))  # at step s, the first live[s] sequences are still there
    live = [sum(len(y) > s for _, y in seqs) for s in range(len(seqs[0][1]))]
    kind = [np.array([x[s] for x, _ in seqs[: live[s]]]) for s in range(len(live))]
    x = np.zeros((len(kinds), len(SHAPES)))
    for names, i in kinds.items():
        x[i, list(names)] = 1
    total = sum(live)
    banned = np.zeros((3, 3))
    banned[O, I] = -1e4
    seen_kind, seen_m = np.zeros((len(kinds), 3)), np.zeros((3, 3))
    for names, tags in seqs:
        np.add.at(seen_kind, (names, tags), 1)
        np.add.at(seen_m, (tags[:-1], tags[1:]), 1)
    seen_w = x.T @ seen_kind
    w, m = np.zeros((len(SHAPES), 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    soft = lambda v, axis: np.log(np.exp(v - (top := v.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    start = np.array([0.0, 0.0, -1e4])
    for t in range(1, rounds + 1):
        e, mm = x @ w, m + banned
        alpha = [e[kind[0]] + start]
        for s in range(1, len(live)):
            alpha.append(soft(alpha[s - 1][: live[s], :, None] + mm, 1) + e[kind[s]])
        z = np.concatenate([soft(alpha[s][(live[s + 1] if s + 1 < len(live) else 0) :], 1) for s in reversed(range(len(live)))])  # by sequence, the longest first
        beta = np.zeros((len(seqs), 3))
        want_kind, want_m = np.zeros((len(kinds), 3)), np.zeros((3, 3))
        for s in reversed(range(len(live))):
            here = beta[: live[s]]
            np.add.at(want_kind, kind[s], np.exp(alpha[s] + here - z[: live[s], None]))
            if s:
                after = e[kind[s]] + here
                want_m += np.exp(alpha[s - 1][: live[s], :, None] + mm + after[:, None, :] - z[: live[s], None, None]).sum(0)
                beta[: live[s]] = soft(mm[None] + after[:, None, :], 2)
        for grad, value, k in (((seen_w - x.T @ want_kind) / total - ridge * w, w, 0), ((seen_m - want_m) / total - ridge * m, m, 2)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * grad**2
            value += 0.1 * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 1] / (1 - 0.99**t)) + 1e-8)
    field = Field(w, m + banned)
    field.check()
    return field


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{z}" for a, k, z in spans])


def scan_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            counts, digests, joined = [[], [], []], [], []
            for text in b.column(1).to_pylist():
                base, every = all_spans(text, field)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_texts(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def mask_text(text: str | None, field: Field, mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones as one) replaced."""
    if not text:
        return text
    _, spans = all_spans(text, field)
    out, at, end = [], 0, -1
    for a, _, z in spans:
        if a >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
            at = a
        end = max(end, z)
    if end < 0:
        return text
    return "".join([*out, mark, text[end:]])
