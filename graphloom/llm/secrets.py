"""Secret scans: candidate strings, and a random forest that removes the false positives.

Candidates of a text (the whole of it, of any length): values assigned to a telling name (password, token, key ...), runs of 16
or more token characters that hold a digit, and private keys from their BEGIN to their END line. Overlapping ones are joined to
the first. A forest of decision trees then judges each by

* length, and length of the longest run of one character class,
* character transitions (class changes a character, mean improbability of letters after letters in common words),
* dictionary coverage: the shares of it inside common words and inside placeholders,
* the path around it: slashes, dots, at signs and file endings that touch it,
* neighbouring words: telling names before it, words that speak of hashes, commits or examples.

It is trained from labelled findings, a DataFrame or list of (before, candidate, after, label). The tables here have no
such labels, so ``labelled_findings`` writes ``count`` seeded ones of usual kinds; the count (of a DataFrame ``most``) is the
documented bound on training. Training takes place on the driver and the forest (a few
thousand nodes) is broadcast. Scanning is one pass without shuffle.

Null and empty texts have no candidates; an empty table gives no rows. Very long texts and very long secrets are taken whole. Repeated rows and repeated secrets are found each time. A score of
``threshold`` or more, ties included, is a secret. Offsets are characters. Other columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_KEYED = re.compile(
    rb"""(?i)(?<![a-z0-9])(?:[a-z0-9]{1,20}[_-]){0,2}(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key|client[_-]?secret)["']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}["']?([^\s"',;<>]{4,})"""
)
_BEGIN = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(rb"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_TOKEN = np.zeros(256, np.uint8)
_TOKEN[list(C.ALNUM + b"+/_-")] = 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TELL = re.compile(rb"(?i)(pass|pwd|secret|token|key|auth|cred|bearer|akia)")
_DULL = re.compile(rb"(?i)(commit|sha|md5|hash|checksum|digest|etag|uuid|guid|revision|example|sample|isbn|order|invoice|version|build|id[ :=#]{1,2}$)")
_WORDS = re.compile(
    rb"(?i)(?:password|example|sample|changeme|change|placeholder|your|test|dummy|secret|token|admin|user|name|here|none|null|true|false|config|value|string|default|insert|replace|and|the|that|with|from|this|file|path|image|index|page|home|data|main|build|version|http|www|com|html|json|xxx+|123456?)"
)
_COMMON = (
    "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so "
    "these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get "
    "through back much before go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years "
    "different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something "
    "thought both few those always looked show large often together asked house world going want school important until form food keep children feet land side without boy once animals life enough took four head above kind "
    "password example sample changeme placeholder test dummy secret token admin user config value string default insert replace file path image index page data main build version build server client access private public "
    "der die das und ist nicht ein eine den mit auf für von dem sie wird des aus bei wie nach que los las del con por una para como más pero sus les des dans est pour qui sur par pas plus avec sont cette mais nous"
).split()


def _transitions() -> dict[str, float]:
    """Improbability (bits) of a letter after another, from the common words; smoothed."""
    seen: dict[str, int] = {}
    for w in _COMMON:
        for pair in zip(w, w[1:], strict=False):
            seen["".join(pair)] = seen.get("".join(pair), 0) + 1
    first: dict[str, int] = {}
    for pair, n in seen.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: float(-np.log2((seen.get(a + b, 0) + 0.1) / (first.get(a, 0) + 2.6))) for a in letters for b in letters}


_BITS = _transitions()
_DICTIONARY = re.compile("|".join(sorted({w for w in _COMMON if len(w) >= 4 and w.isascii()}, key=lambda w: (-len(w), w))).encode(), re.I)

FEATURES = (
    "length longest_run class_changes letters digits upper hex entropy improbability placeholders dictionary vowels equals slashes dots at_sign file_end prefix_akia "
    "tell_before dull_before keyed quoted distinct word_after pem"
).split()


def features(before: bytes, cand: bytes, after: bytes, keyed: bool) -> list[float]:
    """The feature values of one candidate with up to 40 bytes of text on either side."""
    n = len(cand)
    a = np.frombuffer(cand, np.uint8)
    lower, upper, digit = (a >= 97) & (a <= 122), (a >= 65) & (a <= 90), (a >= 48) & (a <= 57)
    cls = lower + 2 * upper + 3 * digit
    change = np.flatnonzero(np.diff(cls)) + 1
    edges = np.concatenate([[0], change, [n]])
    _, counts = np.unique(a, return_counts=True)
    p = counts / n
    low = cand.decode("latin-1").lower()
    bits = [_BITS.get(low[k : k + 2], 7.0) for k in range(n - 1)]
    covered = sum(m.end() - m.start() for m in _WORDS.finditer(cand))
    known = sum(m.end() - m.start() for m in _DICTIONARY.finditer(cand))
    return [
        n,
        float(np.diff(edges).max()),
        len(change) / n,
        float((lower | upper).mean()),
        float(digit.mean()),
        float(upper.mean()),
        float(all(c in "0123456789abcdef" for c in low)),
        float(-(p * np.log2(p)).sum()),
        sum(bits) / max(n - 1, 1),
        covered / n,
        known / n,
        sum(c in "aeiou" for c in low) / n,
        cand.count(b"="),
        cand.count(b"/") + before[-1:].count(b"/"),
        (cand + before[-1:] + after[:1]).count(b"."),
        float(b"@" in before[-1:] + after[:1] + cand),
        float(bool(re.match(rb"\.[a-z]{2,4}\b", after)) or bool(re.search(rb"\.[a-z]{2,4}$", cand))),
        float(cand.startswith((b"AKIA", b"ASIA", b"ghp_", b"gho_", b"xox", b"sk_", b"sk-", b"eyJ", b"AIza", b"glpat-"))),
        float(bool(_TELL.search(before))),
        float(bool(_DULL.search(before))),
        float(keyed),
        float(before[-1:] in (b'"', b"'")),
        len(counts) / n,
        float(after[:2].strip()[:1].isalpha()),
        float(cand.startswith(b"-----BEGIN")),
    ]


def _keys(text: bytes) -> list[tuple[int, int]]:
    """Private keys from their BEGIN line to the END line before the next BEGIN, whatever is between; else the BEGIN line."""
    begins = [(m.start(), m.end()) for m in _BEGIN.finditer(text)]
    ends = [m.end() for m in _END.finditer(text)] if begins else []
    out = []
    for k, (a, b) in enumerate(begins):
        at = bisect_right(ends, b)
        after = begins[k + 1][0] if k + 1 < len(begins) else len(text)
        out.append((a, ends[at] if at < len(ends) and ends[at] <= after else b))
    return out


def candidates(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, in order and disjoint; runs are the long token runs with a digit."""
    found = []
    if b"=" in text or b":" in text:
        found += [(m.start(1), m.end(1), "assigned") for m in _KEYED.finditer(text)]
    if b"-----BEGIN" in text:
        found += [(a, b, "pem") for a, b in _keys(text)]
    found += [(a, b, "token") for a, b in runs]
    found.sort(key=lambda f: (f[0], f[2] != "pem", f[2] != "assigned", -f[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2])
            continue
        out.append((a, b, kind))
    return out


def labelled_findings(count: int = 4000, seed: int = 17) -> list[tuple[bytes, bytes, bytes, int]]:
    """Seeded labelled findings of usual kinds: (before, candidate, after, 1 for a secret)."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    chars = lambda s, n: "".join(s[int(i)] for i in rng.integers(0, len(s), n))
    hexa, up, low = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"
    b64 = up + low + "0189+/"
    parts = "the of and ing er on re at th en ver der die das que les mente cion ado para est une des tion ment".split()
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(4))
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "DB_PASSWORD", "SECRET_KEY"]
    out = []
    while len(out) < count:
        k = int(rng.integers(20))
        gap, q = pick(["=", " = ", ": ", ":", "=>"]), pick(["", '"', "'"])
        keyed = f"{prose()} {pick(names)}{gap}{q}"
        plain, tail = f"{prose()} ", pick([q + " " + prose(), q + "\n", ". " + prose(), " " + prose()])
        if k == 0:
            row = (plain, "AKIA" + chars(up, 16), tail, 1)
        elif k == 1:
            row = (pick([plain, keyed]), pick(["ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "AIza"]) + chars(b64[:58], int(rng.integers(20, 40))), tail, 1)
        elif k in (2, 3):
            row = (keyed, chars(hexa, int(pick([16, 18, 20, 24, 32, 40, 64]))), tail, 1)
        elif k in (4, 5):
            row = (keyed, chars(b64, int(rng.integers(12, 48))) + pick(["", "=", "=="]), tail, 1)
        elif k == 6:
            row = (keyed, chars(low, 3) + chars("!@#$%&*0123456789", int(rng.integers(4, 9))) + chars(up, 3), tail, 1)
        elif k == 7:
            row = (plain, "-----BEGIN " + pick(["", "RSA ", "EC "]) + "PRIVATE KEY-----", "\n" + chars(b64, 30), 1)
        elif k == 8:
            row = (plain + pick(["bearer ", "Authorization: Bearer ", "key "]), "eyJ" + chars(b64[:60], 40), tail, 1)
        elif k == 9:
            row = (plain + pick(["commit ", "sha1 ", "checksum ", "md5: ", "revision ", "digest ", "sha256:"]), chars(hexa, int(pick([32, 40, 64]))), tail, 0)
        elif k == 10:
            h = chars(hexa, 32)
            row = (plain + pick(["", "uuid ", "id: ", "guid="]), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", tail, 0)
        elif k == 11:
            row = (keyed, pick(["changeme", "your_password_here", "example", "xxxxxxxx", "password", "None", "null", "<token>", "${TOKEN}", "test1234", "placeholder", "os.environ", "getenv", "true"]), tail, 0)
        elif k == 12:
            row = (plain + pick(["/", "./", "https://", "C:/"]), "/".join(word() for _ in range(int(rng.integers(2, 5)))) + "/" + word() + chars("0123456789", 2), pick([".html", ".png", ".py", "/"]) + tail, 0)
        elif k == 13:
            row = (plain, "-".join(word() for _ in range(int(rng.integers(3, 6)))) + "-" + chars("0123456789", int(rng.integers(1, 5))), tail, 0)
        elif k == 14:
            row = (plain + pick(["", "order ", "tel ", "isbn ", "invoice "]), chars("0123456789", int(rng.integers(16, 24))), tail, 0)
        elif k == 15:
            row = (f"{prose()} {pick(names)}{pick([': ', ' = '])}", word(), " " + prose(), 0)
        elif k == 16:
            row = (plain, word() + word() + word() + chars("0123456789", int(rng.integers(1, 3))) + word(), tail, 0)
        elif k == 17:
            row = (plain + pick(["version ", "build ", "v"]), "-".join(chars("0123456789", 4) for _ in range(4)), tail, 0)
        elif k == 18:
            row = (plain + word() + ".", word() + chars("0123456789", 2) + "_" + word() + "_" + word(), pick(["@", "."]) + "example.com", 0)
        else:
            row = (plain, "_".join([word(), word(), word(), chars("0123456789", 3)]), "(" + tail, 0)
        before, cand, after, label = row
        out.append((before.encode()[-40:], cand.encode(), after.encode()[:40], label))
    return out


class Forest:
    """A random forest of binary decision trees as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.feature, self.cut, self.left, self.value, self.roots = [], [], [], [], []
        tries = max(1, int(np.sqrt(x.shape[1])) + 2)
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.roots.append(len(self.feature))
            todo = [(rows, 0, self._node())]
            while todo:
                at, level, node = todo.pop()
                share = float(y[at].mean())
                self.value[node] = share
                if level == depth or share in (0.0, 1.0) or len(at) < 4:
                    continue
                best = (1e-9, -1, 0.0)
                for f in rng.choice(x.shape[1], tries, replace=False).tolist():
                    v = x[at, f]
                    order = np.argsort(v, kind="stable")
                    s, ones = v[order], np.cumsum(y[at][order])
                    n = np.arange(1, len(at) + 1)
                    ok = np.flatnonzero(s[1:] > s[:-1])
                    if not len(ok):
                        continue
                    nl, ol = n[ok], ones[ok]
                    nr, orr = len(at) - nl, ones[-1] - ol
                    gain = share * (1 - share) - (ol * (nl - ol) / nl + orr * (nr - orr) / nr) / len(at)
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), f, float((s[ok[b]] + s[ok[b] + 1]) / 2))
                if best[1] < 0:
                    continue
                go = x[at, best[1]] <= best[2]
                self.feature[node], self.cut[node], self.left[node] = best[1], best[2], len(self.feature)
                a, b = self._node(), self._node()
                todo += [(at[go], level + 1, a), (at[~go], level + 1, b)]
        self.feature, self.left, self.roots = (np.array(v, np.int32) for v in (self.feature, self.left, self.roots))
        self.cut, self.value = np.array(self.cut), np.array(self.value)

    def _node(self) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.value, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets in the leaves that each row reaches."""
        at = np.tile(self.roots, (len(x), 1))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at].mean(1)
            right = np.take_along_axis(x, np.maximum(f, 0), 1) > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)


def train(findings: DataFrame | list[tuple[bytes, bytes, bytes, int]] | None = None, most: int = 20_000) -> Forest:
    """A forest from findings (before, candidate, after, label); of a DataFrame's rows the most with the smallest hashes are taken."""
    if isinstance(findings, DataFrame):
        rows = findings.where("candidate <> '' AND label is not null").select("before", "candidate", "after", "label").distinct()
        picked = rows.orderBy(F.xxhash64("before", "candidate", "after"), "before", "candidate", "after", "label").limit(most).collect()
        findings = [((r["before"] or "").encode()[-40:], r["candidate"].encode(), (r["after"] or "").encode()[:40], int(r["label"])) for r in picked]
    rows = labelled_findings() if findings is None else findings
    if not rows:
        raise ValueError("no labelled findings to train from")
    x = np.array([features(b, c, a, bool(_KEYED.search(b + c))) for b, c, a, _ in rows])
    return Forest(x, np.array([float(y) for *_, y in rows]))


def scan(texts: pa.Array, forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of every candidate of every text, in bytes."""
    buf, offs = C.raw(texts)
    starts, ends = C.runs(_TOKEN[buf], offs)
    long = ends - starts >= 16
    starts, ends = starts[long], ends[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    some = digits[ends] > digits[starts]
    starts, ends = starts[some], ends[some]
    row = C.row_of(starts, offs)
    cut = np.searchsorted(row, np.arange(len(offs)))
    raw = buf.tobytes()
    out: list[list] = []
    rows, places = [], []
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        text = raw[a:b]
        found = candidates(text, [(int(s) - a, int(e) - a) for s, e in zip(starts[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]], strict=True)])
        out.append([])
        for s, e, kind in found:
            rows.append(features(text[max(0, s - 40) : s], text[s:e], text[e : e + 40], kind == "assigned"))
            places.append((i, s, e, kind))
    if rows:
        for (i, s, e, kind), score in zip(places, forest.score(np.array(rows)).tolist(), strict=True):
            out[i].append((s, e, kind, score))
    return out


def find(docs: DataFrame, keep: list[str], forest: Forest | None = None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns keep, n_candidates and secrets (start, end, kind, score; offsets in characters) of every row."""
    told = docs.sparkSession.sparkContext.broadcast(forest or train())
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_candidates", T.LongType()), T.StructField("secrets", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                texts, n, spans = part.column("_text"), [], []
                for i, found in enumerate(scan(texts, told.value)):
                    n.append(len(found))
                    kept = [f for f in found if f[3] >= threshold]
                    raw = texts[i].as_py().encode() if kept else b""
                    chars = lambda k, raw=raw: len(raw[:k].decode("utf-8", "ignore"))
                    spans.append([{"start": chars(s), "end": chars(e), "kind": kind, "score": score} for s, e, kind, score in kept])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(spans, arrow)], [*keep, "n_candidates", "secrets"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def redact(docs: DataFrame, forest: Forest | None = None, text: str = "text", mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """All columns of docs, each secret in the text replaced by mark."""
    told = docs.sparkSession.sparkContext.broadcast(forest or train())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index(text)
        for batch in batches:
            for a, b in C.chunks(batch, text):
                part = batch.slice(a, b - a)
                texts = part.column(text).to_pylist()
                for i, found in enumerate(scan(part.column(text), told.value)):
                    kept = [f for f in found if f[3] >= threshold]
                    if kept:
                        raw, out, at = texts[i].encode(), [], 0
                        for s, e, _, _ in kept:
                            out += [raw[at:s], mark.encode()]
                            at = e
                        texts[i] = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
                cols = list(part.columns)
                cols[where] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
