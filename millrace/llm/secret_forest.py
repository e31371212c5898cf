"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more letters, digits and a few marks, of any length, and runs of SHORT or more
that an assignment with a hint word precedes. Each has a vector of length, character
classes, likelihood under letter transitions, dictionary coverage, path-like shape, the words around it
and those of its file's path, where documents have one. The forest is trained here on labelled findings. With no labelled table at hand the findings are
written by rule: keys, tokens and passwords in assignments on one side; checksums, identifiers, paths,
long numbers and joined words in prose on the other. A table (token, before, after, secret, and a path if
there are paths) may be given instead; at most MAX_FINDINGS of its rows are used for fitting. Scanning covers every text whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.words import row_slices

TREES = 40
DEPTH = 8
MAX_FINDINGS = 20_000
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/=.\-])[A-Za-z0-9_+/=.\-]{16,}")
SHORT = 6
AROUND = 48
HINTS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "bearer", "credential", "private", "access")
HARMLESS = ("checksum", "sha", "sha1", "sha256", "md5", "hash", "commit", "digest", "revision", "uuid", "id", "etag", "url", "path", "file", "example", "version")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_")
#: Words of paths that hold samples, and of paths that hold settings.
SAMPLES = ("test", "tests", "example", "examples", "sample", "samples", "fixture", "fixtures", "mock", "mocks", "demo", "doc", "docs", "lock", "vendor", "spec")
SETTINGS = ("env", "config", "configs", "conf", "settings", "credentials", "secrets", "deploy", "yml", "yaml", "ini", "properties", "tfvars", "pem")
#: A shorter value after an assignment, and the name before it, which must hold a hint word.
_VALUE = re.compile(rf"[:=][ \t]*[\"']?(?P<value>[A-Za-z0-9_+/.\-][A-Za-z0-9_+/=.\-]{{{SHORT - 1},14}})(?![A-Za-z0-9_+/=.\-])")
_HINTED = re.compile(rf"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:{'|'.join(HINTS)})(?:s|\d+|[_\-][A-Za-z0-9_\-]{{0,24}}|[A-Z][A-Za-z0-9]{{0,24}})?[\"']?[ \t]*$")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
DICTIONARY = (
    "the and for with that this from have not are was were will would can could should about which their there one two time people year work "
    "data file path user name test example config service server client request response value default home local share build source main "
    "index page image report version update table document list number system value get set new old after before because between first last long "
    "other over same some such than then these those through under very where while without world water house school state night point right place "
    "string object function return class method field array count start stop read write open close create delete send load save login session "
    "der die das und nicht mit ist auch auf eine wird werden sich nach haben oder aber mehr wenn les des est une dans pour que qui sur par pas avec "
    "plus los las para con una por como pero esta este todo muy"
).split()
_WORDS = frozenset(DICTIONARY)


def _transitions() -> np.ndarray:
    """Log probabilities of letter pairs, from the dictionary words themselves, smoothed."""
    counts = np.full((27, 27), 0.3)
    for word in DICTIONARY:
        codes = [0, *(ord(c) - 96 for c in word), 0]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


_LOG = _transitions()


def features(token: str, before: str, after: str, path: str = "") -> list[float]:
    """The vector of a candidate from its text, the text around it and the path of its file, if any."""
    low = token.lower()
    steps = re.findall(r"[a-z]+", _CAMEL.sub(" ", path).lower())
    n = len(token)
    letters = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in low]
    _, counts = np.unique(list(token), return_counts=True)
    share = counts / n
    parts = [p for p in re.split(r"[^a-z]+", low) if p]
    covered = sum(len(p) for p in parts if p in _WORDS)
    vowels = sum(c in "aeiou" for c in low)
    near = re.findall(r"[a-z0-9]+", _CAMEL.sub(" ", before).lower())[-4:]
    behind = re.findall(r"[a-z0-9]+", after.lower())[:2]
    digits = sum(c.isdigit() for c in token)
    return [
        n, float(_LOG[letters[:-1], letters[1:]].mean()), covered / n, float(-(share * np.log2(share)).sum()), digits / n,
        sum(c.isupper() for c in token) / n, vowels / n, token.count("/") / n, token.count(".") / n, token.count("-") / n, token.count("_") / n,
        float(bool(re.fullmatch(r"[0-9a-f]+", low))), float(bool(re.search(r"\.[a-z]{2,4}$", low))), float(any(token.startswith(p) for p in PREFIXES)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(any(w in HINTS for w in near)), float(any(w in HARMLESS for w in near + behind)),
        float(after[:1] in "\"'"), float(low.endswith("=")), float(digits == n),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))), max((len(p) for p in parts), default=0) / n,
        float(bool(path)), float(any(s in SAMPLES for s in steps)), float(any(s in SETTINGS for s in steps)),
    ]


def rule_findings(n: int = 4000, seed: int = 5) -> list[tuple[str, str, str, int, str]]:
    """Labelled findings (token, before, after, secret, path) written by rule; half of them without a path."""
    rng = np.random.default_rng(seed)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def pick(of, k: int) -> str:
        return "".join(of[i] for i in rng.integers(0, len(of), k))

    def word() -> str:
        return DICTIONARY[rng.integers(len(DICTIONARY))]

    def prose(k: int) -> str:
        return " ".join(word() if rng.random() < 0.5 else pick("aeiounrstldhen", int(rng.integers(2, 9))) for _ in range(k))

    out = []
    for i in range(n):
        hexed = hashlib.sha512(f"{seed}/{i}".encode()).hexdigest()
        kind = int(rng.integers(19))
        assign = [" = ", "=", ": ", ' = "', '="', ': "'][rng.integers(6)]
        hint = HINTS[rng.integers(len(HINTS))]
        hint = [hint, f"{word()}_{hint}", hint.upper()][rng.integers(3)]
        close = '"' if assign.endswith('"') else " "
        if kind == 0:
            made = ("AKIA" + pick(alnum[26:], 16), prose(3) + " ", " ", 1)
        elif kind == 1:
            made = (PREFIXES[rng.integers(2, len(PREFIXES))] + pick(alnum, int(rng.integers(24, 48))), prose(3) + [" ", assign][rng.integers(2)], close, 1)
        elif kind in (2, 3):
            made = (hexed[: [32, 40, 64][rng.integers(3)]], f"{prose(2)} {hint}{assign}", close, 1)
        elif kind in (4, 5):
            made = (pick(alnum + "+/", int(rng.integers(20, 60))) + "=" * int(rng.integers(3)), f"{prose(2)} {hint}{assign}", close, 1)
        elif kind == 6:
            harmless = HARMLESS[rng.integers(11)]
            made = (hexed[: [32, 40, 64][rng.integers(3)]], f"{prose(2)} {harmless}{[' ', assign][rng.integers(2)]}", " ", 0)
        elif kind == 7:
            made = (f"{hexed[:8]}-{hexed[8:12]}-{hexed[12:16]}-{hexed[16:20]}-{hexed[20:32]}", prose(3) + " ", " ", 0)
        elif kind == 8:
            made = ("/".join(word() for _ in range(int(rng.integers(4, 8)))) + [".html", ".py", "", "/"][rng.integers(4)], prose(2) + [" ", assign][rng.integers(2)], " ", 0)
        elif kind == 9:
            made = (pick("0123456789", int(rng.integers(16, 24))), prose(3) + " ", prose(1), 0)
        elif kind == 10:
            made = (["", "-", "_"][rng.integers(3)].join(prose(5).split()), prose(3) + [" ", f" {hint} "][rng.integers(2)], " " + prose(2), 0)
        elif kind == 11:
            made = (hexed[: int(rng.integers(16, 64))], prose(4) + " ", " " + prose(2), 0)
        elif kind == 12:
            signed = ".".join(["ey" + pick(alnum, int(rng.integers(16, 50))), "ey" + pick(alnum + "-_", int(rng.integers(40, 900))), pick(alnum + "-_", int(rng.integers(40, 350)))])
            made = (signed, prose(2) + [f" {hint}{assign}", " Authorization: Bearer ", " "][rng.integers(3)], close, 1)
        elif kind == 13:
            made = (pick(alnum + "+/", int(rng.integers(60, 2400))) + "=" * int(rng.integers(3)), f"{prose(2)} {hint}{assign}", close, 1)
        elif kind == 14:
            made = (pick(alnum[: [26, 52][rng.integers(2)]], int(rng.integers(16, 48))), f"{prose(2)} {hint}{assign}", close, 1)
        elif kind == 15:
            short = [pick(alnum, int(rng.integers(SHORT, 16))) + pick("0123456789", 1), word() + pick("0123456789", int(rng.integers(2, 5))), pick(alnum[:52], int(rng.integers(8, 16)))]
            made = (short[rng.integers(3)][:15], f"{prose(2)} {hint}{assign}", close, 1)
        elif kind == 16:
            spoken = "".join("bcdfghklmnprstvw"[a] + "aeiou"[b] + "nrstl  "[c] for a, b, c in zip(rng.integers(0, 16, 5), rng.integers(0, 5, 5), rng.integers(0, 7, 5), strict=True)).replace(" ", "")
            plain = [word(), f"{word()}{['-', '_', '.', ''][rng.integers(4)]}{word()}", pick("0123456789", int(rng.integers(SHORT, 12))), spoken[: int(rng.integers(SHORT, 13))]]
            made = (plain[rng.integers(4)][:15], f"{prose(2)} {hint}{assign}", close, 0)
        elif kind == 17:
            joined = "".join("bcdfghklmnprstvw"[a] + "aeiou"[b] + "nrstl "[c] for a, b, c in zip(rng.integers(0, 16, 12), rng.integers(0, 5, 12), rng.integers(0, 6, 12), strict=True)).replace(" ", "")
            joined = [joined, joined.upper(), joined.title()][rng.integers(3)] + ["", "."][rng.integers(2)]
            names = "".join(word().title() for _ in range(5))
            made = ([pick("-=_./+"[rng.integers(6)], 1) * int(rng.integers(16, 400)), joined, names, names[0].lower() + names[1:]][rng.integers(4)], prose(2) + [" ", f" {hint} ", f" {word()}{assign}"][rng.integers(3)], " " + prose(1), 0)
        else:
            made = (pick(alnum + "+/", int(rng.integers(60, 2400))) + "=" * int(rng.integers(3)), prose(2) + f" data:{['image/png', 'font/woff2', 'image/gif'][rng.integers(3)]};base64,", close, 0)
        if len(made[0]) >= 16 or kind in (15, 16) and len(made[0]) >= SHORT:
            # Secrets stand more often in settings than in samples, other tokens the other way round.
            of = [SETTINGS, SAMPLES][int(rng.random() < (0.2 if made[3] else 0.7))]
            path = ["", f"src/{word()}/{of[rng.integers(len(of))]}/{word()}.txt", "", f"{word()}/{word()}.py"][rng.integers(4)]
            out.append((*made, path))
    return out


@dataclass
class Tree:
    """Arrays by node: feature (-1 at a leaf), threshold, left and right node, share of secrets."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    share: list[float]


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> Tree:
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, level: int) -> int:
        me = len(tree.feature)
        for values, value in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.share), (-1, 0.0, -1, -1, float(y[rows].mean())), strict=True):
            values.append(value)
        if level == depth or len(rows) < 6 or tree.share[me] in (0.0, 1.0):
            return me
        best = (1e9, -1, 0.0)
        for f in rng.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], np.cumsum(y[rows][order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            if len(k):
                a, b = t[k - 1] / k, (t[-1] - t[k - 1]) / (len(rows) - k)
                cost = k * a * (1 - a) + (len(rows) - k) * b * (1 - b)
                i = int(cost.argmin())
                best = min(best, (float(cost[i]), int(f), float((v[k[i]] + v[k[i] - 1]) / 2)))
        if best[1] < 0:
            return me
        go = x[rows, best[1]] <= best[2]
        tree.feature[me], tree.threshold[me] = best[1], best[2]
        tree.left[me] = node(rows[go], level + 1)
        tree.right[me] = node(rows[~go], level + 1)
        return me

    node(np.arange(len(y)), 0)
    return tree


class Forest:
    def __init__(self, findings: list[tuple], seed: int = 3):
        x = np.array([features(*f[:3], *f[4:5]) for f in findings])
        y = np.array([f[3] for f in findings], float)
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(_grow(x[rows], y[rows], rng))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees."""
        total = np.zeros(len(x))
        for t in self.trees:
            f, c, left, right = (np.array(v) for v in (t.feature, t.threshold, t.left, t.right))
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                at = np.where(inner, np.where(x[np.arange(len(x)), f[at]] <= c[at], left[at], right[at]), at)
            total += np.array(t.share)[at]
        return total / len(self.trees)


def train(findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings, or from those written by rule. Null strings count as empty, null labels are left out."""
    if findings is None:
        return Forest(rule_findings())
    rows = findings.where("secret is not null and length(token) > 1").orderBy(F.xxhash64("token", "before", "after")).limit(MAX_FINDINGS).collect()
    return Forest([(r["token"], r["before"] or "", r["after"] or "", int(r["secret"]), (r["path"] or "") if "path" in findings.columns else "") for r in rows])


def find(texts: list[str], forest: Forest, threshold: float = 0.5, paths: list[str | None] | None = None) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Number of candidates of each text, and the code point ranges judged to be secrets."""
    spans, rows, vectors = [], [], []
    for i, text in enumerate(texts):
        runs = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            # An assignment without spaces is one run: its value is the candidate.
            head = re.match(r"[A-Za-z_.\-]{2,40}=(?=[^=])", m[0])
            if head and b - a - head.end() >= (SHORT if _HINTED.search(m[0][: head.end() - 1]) else 16):
                a += head.end()
            runs.append((a, b))
        taken = 0
        long = list(runs)
        for m in _VALUE.finditer(text):
            a = m.start("value")
            b = a + len(m["value"].rstrip("."))
            while taken < len(long) and long[taken][1] <= a:
                taken += 1
            free = taken == len(long) or b <= long[taken][0]
            if free and b - a >= SHORT and _HINTED.search(text[max(0, m.start() - AROUND) : m.start()]):
                runs.append((a, b))
        for a, b in sorted(runs):
            token = text[a:b]
            spans.append((a, b))
            rows.append(i)
            vectors.append(features(token, text[max(0, a - AROUND) : a], text[b : b + AROUND], (paths[i] or "") if paths else ""))
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if vectors:
        for i, span, score in zip(rows, spans, forest.score(np.array(vectors)), strict=True):
            if score >= threshold:
                found[i].append(span)
    return np.bincount(rows, minlength=len(texts)).tolist() if rows else [0] * len(texts), found


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<secret>") -> str:
    out, last = [], 0
    for a, b in spans:
        out += [text[last:a], mark]
        last = b
    return "".join(out) + text[last:]


def scan(documents: DataFrame, forest: Forest | None = None) -> DataFrame:
    """Every row and column of `documents`, text redacted, with n_candidates and secrets (array of start, stop).

    Ranges are code points of the original text. A column `path`, if there is one, names each text's file; a null one
    is none. A null text stays null and has no candidates; an empty one
    stays empty. Rows are independent, so repeated rows and null ids pass through; columns named like the
    results are replaced; an empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(forest or train())
    docs = documents.withColumn("text", F.col("text").cast("string")).drop("n_candidates", "secrets")
    spans_type = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    schema = T.StructType(list(docs.schema.fields)).add("n_candidates", "long").add("secrets", spans_type)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                paths = batch.column("path").cast(pa.string()).to_pylist() if "path" in batch.schema.names else None
                counts, found = find([t or "" for t in texts], shared.value, paths=paths)
                clean = [t if not s else redact(t, s) for t, s in zip(texts, found, strict=True)]
                columns = [pa.array(clean, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
                spans = pa.array([[{"start": a, "stop": b} for a, b in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), spans], [*batch.schema.names, "n_candidates", "secrets"])

    return docs.mapInArrow(run, schema)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets and the digest of the redacted text per document.

    Rows and edge cases are those of `scan`; the digest of a null text is null. Other columns but path are ignored.
    """
    return scan(documents.select("doc_id", "text", *[c for c in documents.columns if c == "path"])).select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", F.sha2("text", 256).alias("redacted_sha256")
    )
