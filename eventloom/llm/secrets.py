"""Secret scans: patterns, and the guess cost of values in a credential context.

The base kinds (assign, access, hex) are leftmost non-overlapping matches with a least length. The method adds ``guess``
spans: values that follow a credential word (``password is ...``, ``login: ...``, ``secret = ...``) whose guess cost is at
least ``MIN_GUESSES``, whether a base span covers them or not. A value is the run of non-space characters, less closing
punctuation, or what its quotes hold up to a space. Only prose isn't costed: letters of one case and, where neither ``:`` nor
``=`` stands before, the marks that join or enclose words. The cost is the cheapest segmentation of the value, found by dynamic
programming over its places and two states (in a brute-force span or not), into dictionary words, dates, repeats of a character
or of a block, keyboard walks, alphabet sequences and brute-force spans. The dictionary is a parameter.

Null text counts as empty: no spans. Offsets are code points, the end exclusive. Repeated rows stay; an empty table gives
an empty result; only doc_id and text are read. A value of any length is costed in O(length * 64) steps, and only until no segmentation under
``MIN_GUESSES`` is left.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import map_batches, map_stream, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run's tail is shorter than the run: the same matches as AKIA[A-Z0-9]+ of 20+
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?:\b(?:pass ?phrase|pwd|login|credentials?|private[ _]key|auth|(?:password|passwd|secret|token|api_?key)(?: is| was))["']?\s*(?:[:=]|\bis\b|\bwas\b|\s)|(?:password|passwd|secret|token|api_?key)["']?\s*[:=])\s*(?=\S{6})""", re.ASCII | re.IGNORECASE)
_SPACE = re.compile(r"\s|\Z", re.ASCII)
_CLOSING, _BRACKETS = ".,;:!?)]}>\"'`", "()[]{}<>"
_JOINTS = str.maketrans("", "", _BRACKETS + "\"'`’‘“”«»-–—/._,:;…")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = (*ASSIGN_WORDS, "phrase", "pwd", "login", "credential", "private", "auth")
MIN_GUESSES = 10.0  # log10
KINDS = {"assign": 0, "access": 1, "hex": 2, "guess": 3}

#: Common passwords and words, about the most common first; fixed values. A longer list can be given instead.
WORDS = """
password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football shadow
secret test user root guest default changeme example token key the and for you that with this from have love god baby summer
winter spring autumn hello world super batman hunter trustno1 baseball superman michael jennifer jordan harley ranger thomas
robert daniel andrew joshua matthew charlie george jessica ashley amanda nicole hannah maggie ginger pepper cookie banana
orange apple cheese coffee chocolate purple yellow silver golden diamond flower butterfly tiger eagle falcon panther mustang
corvette ferrari porsche yankees cowboys lakers chelsea arsenal liverpool soccer hockey tennis golf killer hacker access pass
phrase private public server system database service account manager office computer internet google windows linux oracle
temp demo sample money lucky freedom whatever nothing forever family friend mother father sister brother angel heaven
blue green black white red happy crazy sweet magic rainbow star moon sun sky water fire earth house home london paris
january february march april june july august september october november december monday friday sunday school student work
""".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?\d{1,2}(?:[-/.]?\d{1,2})?)?|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d\d)")
_LEET = str.maketrans("@4031$5!7", "aaoelssit")
BLOCK = 8  # characters of a block whose repeats are a segment, at most
OVERLAP = 64  # a run's end shares fewer characters than this with what may follow: a word, a date or a run of another kind


def _adjacent(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _space(c: str) -> float:
    """log10 of the alphabet that a character is guessed from."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


class Dictionary:
    """Words by rank, the most common first."""

    def __init__(self, words: Iterable[str]):
        self.cost: dict[str, float] = {}
        for rank, w in enumerate(words, 1):
            self.cost.setdefault(w.lower(), math.log10(rank + 1))
        self.longest = max(map(len, self.cost), default=0)


COMMON = Dictionary(WORDS)


def guess_cost(value: str, limit: float = math.inf, words: Dictionary = COMMON, blocks: bool = True) -> float:
    """log10 of the guesses of the cheapest segmentation; each further segment costs log10(2) for its order. Infinite from ``limit`` on.

    A run may end early only for a segment that goes on beyond it: else its whole length costs less than what would cover
    the rest. So of a long run the last ``OVERLAP`` ends are tried.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    closed = [0.0] + [math.inf] * n  # the cheapest up to a place whose last segment is no brute-force span
    brute = [math.inf] * (n + 1)  # and whose last is one
    until = [0] * (BLOCK + 1)  # where the run of blocks of a length ends that was found last
    inside: dict[str, float] = {}  # costs of blocks
    ends = [0, 0, 0]  # where the last repeat, walk and sequence end
    follows = (lambda a, b: a == b, _adjacent, lambda a, b: ord(b) - ord(a) == 1)
    another = math.log10(2)
    live = 0  # the furthest place that is reached under the limit
    for i in range(n):
        if i > live:
            return math.inf
        best = min(closed[i], brute[i])
        if best >= limit:
            continue
        here = best + (another if i else 0)

        def offer(length: int, cost: float) -> None:
            nonlocal live
            if here + cost < min(closed[i + length], limit):
                closed[i + length] = here + cost
                live = max(live, i + length)

        brute[i + 1] = min(brute[i], closed[i] + (another if i else 0)) + _space(value[i])
        if brute[i + 1] < limit:
            live = max(live, i + 1)
        for length in range(3, min(n - i, words.longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.5)):
                cost = words.cost.get(form[i : i + length])
                if cost is not None:
                    offer(length, cost + extra + (0.5 if value[i : i + length] != low[i : i + length] else 0))
        if value[i].isdigit():
            for length in range(4, min(n - i, 10) + 1):
                if _DATE.fullmatch(value, i, i + length):
                    offer(length, 4.6 if length > 4 else 2.1)
        for k, (least, cost) in enumerate(((2, 1.5), (3, 2.0), (2, 1.5))):
            if ends[k] <= i:
                end = i + 1
                while end < n and follows[k](low[end - 1], low[end]):
                    end += 1
                ends[k] = end
            whole = ends[k] - i - 1  # steps from here on
            for r in range(max(least, whole - OVERLAP), whole + 1):
                offer(r + 1, cost + math.log10(r + 1))
        for size in range(2, BLOCK + 1) if blocks else ():
            if until[size] < i + 2 * size and value.startswith(value[i : i + size], i + size):
                end = i + 2 * size
                while end < n and value[end] == value[end - size]:
                    end += 1
                until[size] = end
            most = (until[size] - i) // size
            if most > 1:
                block = value[i : i + size]
                if block not in inside:
                    inside[block] = guess_cost(block, words=words, blocks=False)
                for times in range(max(2, most - OVERLAP // size), most + 1):
                    offer(times * size, inside[block] + math.log10(times))
    best = min(closed[n], brute[n])
    return best if best < limit else math.inf


def _closing(text: str, quote: str, a: int, end: int) -> int:
    """Place of the quote that closes a value, -1 if there is none before ``end``."""
    b = text.find(quote, a, end)
    while b > 0 and text[b - 1] == "\\":
        b = text.find(quote, b + 1, end)
    return b


def _prose(value: str, loose: bool) -> bool:
    """Prose is no secret: letters without digits, symbols or a change of case inside."""
    value = value.translate(_JOINTS) if loose else value.strip(_BRACKETS)
    return not any(c.isdigit() or category(c)[0] in "PS" for c in value) and not value[1:].lower() != value[1:] != value[1:].upper()


def scan_text(text: str | None, words: Dictionary = COMMON) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base, all) spans as (start, kind, end), by start and kind."""
    if not text:
        return [], []
    low = text.lower()
    base = []
    if any(w in low for w in ASSIGN_WORDS):
        base += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    more = []
    if any(w in low for w in CONTEXT_WORDS):
        end = stop = done = 0  # ends: of the run of non-space characters, without its closing marks, of the last value found
        for m in CONTEXT.finditer(text):
            a = m.end()
            if a < done:
                continue
            if a >= end:
                end = _SPACE.search(text, a).start()
                stop = a + len(text[a:end].rstrip(_CLOSING))
            quote = text[a] if text[a] in "\"'" else ""
            a += len(quote)
            b = _closing(text, quote, a, end) if quote else -1
            if b < 0:
                b = stop
            if b - a < 6:
                continue
            value = text[a:b]
            if not _prose(value, not any(c in ":=" for c in m[0])) and guess_cost(value, MIN_GUESSES, words) >= MIN_GUESSES:
                more.append((a, "guess", b))
                done = b
    order = lambda x: (x[0], KINDS[x[1]])
    return sorted(base, key=order), sorted(base + more, key=order)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, words: Dictionary = COMMON) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            base, spans = scan_text(text.as_py(), words)
            kinds = [k for _, k, _ in spans]
            out.append({"doc_id": doc_id, **{f"n_{k}": kinds.count(k) for k in ("assign", "access", "hex")}, "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans), "n_guess": kinds.count("guess")})
        return pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())]))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(docs: DataFrame, mark: str = "[secret]", words: Dictionary = COMMON) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping spans together) and n_chars to match; columns and rows stay."""
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            texts = []
            for t in b.column(at).to_pylist():
                last, parts = 0, []
                for a, _, e in scan_text(t, words)[1]:
                    if a >= last:
                        parts += [t[last:a], mark]
                    last = max(last, e)
                texts.append(t if t is None or not parts else "".join([*parts, t[last:]]))
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_stream(docs, run, docs.schema)


def op5_secret_scans(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def base_spans(spark, sf_dir):
    """The base part of op5, which SQL can express."""
    return op5_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


#: Places come from the lengths of what stands between the matches, and of the matches before.
BASE_SPANS_SQL = r"""
WITH k(kind, rank, pattern, least, part) AS (VALUES
  ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6, 2),
  ('access', 1, '(AKIA[A-Z0-9]+)()', 20, 1), ('hex', 2, '([0-9a-f]+)()', 24, 1)
), d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT n, kind, rank, least, regexp_split_to_array(text, pattern) AS gap, regexp_extract_all(text, pattern) AS hit, regexp_extract_all(text, pattern, part) AS value
  FROM d, (SELECT * FROM k) k
), p AS (
  SELECT n, kind, rank, least, unnest(gap[: len(hit)]) AS gap, unnest(hit) AS hit, unnest(value) AS value, generate_subscripts(hit, 1) AS i FROM f
), s AS (
  SELECT n, kind, rank, least, value, sum(length(gap) + length(hit)) OVER (PARTITION BY n, kind ORDER BY i) AS until, length(hit) AS size FROM p
), b AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || (until - size)::BIGINT || ':' || until::BIGINT, ',' ORDER BY until - size, rank) AS spans
  FROM s WHERE length(value) >= least GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN b USING (n)
"""
