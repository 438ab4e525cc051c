"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

Base kinds, leftmost and non-overlapping each: ``assign`` (a sensitive name set to a value of six
characters or more; the span is the whole match), ``access`` (access-key ids) and ``hex`` (long runs
of lower-case hex digits).

``novel`` adds what no pattern names: a candidate is a token of key characters that mixes letters and
digits, with a sensitive word in it or close to it on either side. Its
marginal size is what it adds to the compressed text around it, when the compressor is primed with a
dictionary of identifiers: the size of surroundings and token less that of the surroundings alone. Parts of
known identifiers or of the surrounding text cost few bytes; a key costs about its entropy. All is lower-cased
first, so that words in any case are known. A candidate that costs at least ``of_random`` of what a random
string of its length and alphabet costs by the same means is reported unless it overlaps a base span.

Defined cases: null and empty texts have no spans; whole texts are scanned, however long; rows that
repeat are each returned; spans of equal start are in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.support import append_columns, small_batches

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(r"(?:passw|secret|token|api[\x20_-]?key|credential|private[\x20_-]?key|access[\x20_-]?key|client[\x20_-]?id|auth|bearer|signature)", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}", re.ASCII)
#: Characters that a key's writing uses together.
_ALPHABETS = tuple((re.compile(f"[{some}]", re.ASCII), every) for some, every in (("g-z", "abcdefghijklmnopqrstuvwxyz"), ("a-f", "abcdef"), ("G-Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("A-F", "ABCDEF"), ("0-9", "0123456789"), ("+", "+"), ("/", "/"), ("_", "_"), ("-", "-")))

#: Words one of which an assign match, or a candidate's context, holds in lower case; and hex digits as "h".
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_SENSITIVE_WORDS = ("passw", "secret", "token", "key", "credential", "client", "auth", "bearer", "signature")
_HEX_BYTES = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_HEX_RUN = b"h" * 24

#: Identifiers, configuration words and shapes that code and prose have around keys.
IDENTIFIERS = (
    "access account address admin algorithm api application argument array async attribute auth "
    "authorization await base64 bearer boolean bucket buffer bytes cache callback catch certificate "
    "class client cluster column commit config configuration connection const constant container "
    "content context cookie count create credential current database default define delete description "
    "development directory document domain element email enabled encoding encrypt endpoint environment "
    "error event example exception export expire false field file filter format from function handler "
    "hash header host http https identifier image import index information initialize input instance "
    "integer interface internal item iterator json key label language length library license limit list "
    "local location login main manager map master message metadata method model module name namespace "
    "network node null number object option order output package parameter parent parse password path "
    "pattern permission pipeline port prefix private process production profile project property "
    "protocol provider proxy public query queue random read record region register release remote "
    "repository request resource response result return role root route schema scope script search "
    "secret security select sequence server service session setting signature size source stack start "
    "state static status storage stream string struct system table target template test text thread "
    "time timeout timestamp title token total trace transaction true type undefined unique update "
    "upload url user username uuid value variable vector version view void worker write "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
).encode()


@dataclass(frozen=True)
class SecretScan:
    """reach: characters between a sensitive word and a candidate; around: characters of context
    on either side; of_random: share of a random string's cost that makes a key; seeds: random strings
    that are averaged."""

    reach: int = 48
    around: int = 512
    of_random: float = 0.8
    seeds: int = 5


def _any_in(words: tuple[str, ...], text: str) -> bool:
    """A substring search for each word is far cheaper than one pattern over the whole text."""
    return any(w in text for w in words)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans (start, end, kind), by kind as listed."""
    out: list[tuple[int, int, str]] = []
    if ("=" in text or ":" in text) and _any_in(_ASSIGN_WORDS, text.lower()):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


#: Prose that stands before the surroundings, so that a few words of them don't set the statistics.
CARRIER = (
    "people went down to the river in the morning and came back late with what they had found there; nobody asked how much it was worth. "
    "for each row the program checks whether its value is larger than the last one, then it writes both of them and goes on to the next page. "
    "we hope that this will help you, but if it does not, please tell us about your problem and which of the steps above did fail. "
).encode()


class Novelty:
    """Marginal compressed size of a candidate, given its surroundings."""

    def __init__(self, p: SecretScan):
        self.p = p
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.lower(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)
        self.random_costs: dict[tuple[str, int], float] = {}

    def _marginal(self, around: bytes, token: bytes) -> float:
        """Bytes that the token adds, a byte of it."""
        return (len(self.press.compress(around + b" " + token)) - len(self.press.compress(around + b" "))) / len(token)

    def random_cost(self, alphabet: str, length: int) -> float:
        """Mean cost a character of random strings of an alphabet; there are at most some hundred alphabets."""
        found = self.random_costs.get((alphabet, length))
        if found is None:
            if len(self.random_costs) >= 65536:
                self.random_costs.clear()
            found = self.random_costs[alphabet, length] = self._random_cost(alphabet, length)
        return found

    def _random_cost(self, alphabet: str, length: int) -> float:
        made = ["".join(random.Random(length * 31 + k).choices(alphabet, k=length)) for k in range(self.p.seeds)]
        return sum(self._marginal(CARRIER, x.lower().encode()) for x in made) / len(made)

    def cost(self, text: str, start: int, end: int) -> float:
        before = text[max(0, start - self.p.around) : start]
        after = text[end : end + self.p.around]
        return self._marginal(CARRIER + f"{after} {before}".lower().encode("utf-8"), text[start:end].lower().encode("utf-8"))

    def least(self, token: str) -> float:
        """The cost a character from which a token is a key; it hardly changes beyond some length.

        Kinds of characters that make up under a sixteenth, as of a word glued to a key, don't count.
        """
        most = max(1, len(token) // 16)
        alphabet = "".join(dict.fromkeys("".join(every for some, every in _ALPHABETS if len(some.findall(token)) >= most)))
        return self.p.of_random * self.random_cost(alphabet, min(len(token), 16384))

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        if not _any_in(_SENSITIVE_WORDS, text.lower()):
            return out
        words = [word.span() for word in _SENSITIVE.finditer(text)]
        if not words:
            return out
        # Matches don't overlap, so their starts and their ends both ascend.
        starts, ends = [a for a, _ in words], [b for _, b in words]
        busy = sorted((a, b) for a, b, _ in taken)
        for m in _CANDIDATE.finditer(text):
            # The first word that ends close enough before the token or later.
            at = bisect_left(ends, m.start() - self.p.reach)
            if at == len(ends) or starts[at] > m.end() + self.p.reach:
                continue
            if not any(a < m.end() and m.start() < b for a, b in busy) and self.cost(text, *m.span()) >= self.least(m.group()):
                out.append((m.start(), m.end(), "novel"))
        return out


def all_spans(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + novelty.spans(text, base), key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, p: SecretScan = SecretScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of each row of docs."""
    small_batches(docs.sparkSession)

    def maker():
        novelty = Novelty(p)

        def compute(column: pa.Array) -> list[pa.Array]:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for text in column.to_pylist():
                base, every = all_spans(text or "", novelty)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in every))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            return [pa.array(counts[k], pa.int64()) for k in KINDS] + [pa.array(digests, pa.string()), pa.array(spans, pa.string())]

        return compute

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return append_columns(rows, fields, maker, drop=("text",))


def redact_text(text: str, novelty: Novelty, mark: str = "[secret]") -> str:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    _, spans = all_spans(text, novelty)
    out, at = [], 0
    for a, b, _ in spans:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, p: SecretScan = SecretScan()) -> DataFrame:
    """docs with the secrets of ``text`` replaced by a mark; other columns and null texts stay."""
    small_batches(docs.sparkSession)

    def maker():
        novelty = Novelty(p)
        return lambda column: [pa.array([t if t is None else redact_text(t, novelty) for t in column.to_pylist()], pa.string())]

    return append_columns(docs, [T.StructField("text", T.StringType())], maker).select(docs.columns)
