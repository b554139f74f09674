"""Secret scans by a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every
match must hold. Every block of documents (an Arrow batch of one Spark task) is indexed:
the trigrams of its lower-cased bytes are read once, and each that some rule asks for gets
the numbers of the documents that hold it. A rule's query intersects and unites these postings, and only the documents that are
left are searched with the expression itself. Rules without a mandatory trigram (runs of
hex digits) search every document. A block lives and dies in its task: no shuffle, nothing
on disk, and a lost executor costs a re-read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Alternatives of one run of literals that are kept apart; beyond, the run asks nothing.
MAX_STRINGS = 64
#: Starts a run whose left side is not known.
CUT = "\0"
#: Between the documents of a block; no byte of UTF-8.
BETWEEN = b"\xff\xff"
#: Bytes of a block that are turned into trigrams at a time.
STEP = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `least` characters of `group` make a match count, group `span` is the secret."""
    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    span: int = 0


#: The three kinds the contract names.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.IGNORECASE | re.ASCII, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
)
#: Further well-known public forms.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", re.ASCII),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", re.ASCII, 0, 40),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]+", re.ASCII, 0, 15),
    # From the first head of a run of its characters: where that leads to no match, no later head of the run does.
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+)", re.ASCII, span=1),
)
RULES = BASE_RULES + MORE_RULES


def _all_of(parts):
    parts = frozenset(p for p in parts if p is not None)
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any_of(parts):
    parts = frozenset(parts)
    return None if None in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings):
    """Some string of the set occurs: any of them, each as all its trigrams."""
    strings = [s.lstrip(CUT) for s in strings]
    return _any_of(_all_of(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def trigram_query(pattern: str, flags: int = 0):
    """A query on lower-cased text that holds wherever the pattern matches.

    None: no trigram is mandatory. A string: that trigram. ('and' | 'or', set of queries).
    """
    def walk(items, runs):
        """runs: strings that may stand right before; gives what must hold, and the runs at the end."""
        closed = []
        for op, arg in items:
            strings = None
            if op is sre.LITERAL:
                strings = {chr(arg).lower()}
            elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
                strings = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                query, runs = walk(arg[-1], runs)
                closed.append(query)
                continue
            elif op is sre.BRANCH:
                ends = [walk(alt, {""}) for alt in arg[1]]
                if all(query is None for query, _ in ends):  # plain strings: they may join what is around
                    strings = set().union(*(run for _, run in ends))
                    if any(CUT in s for s in strings):
                        closed.append(_of_strings(strings))
                        strings = None
                else:
                    closed.append(_any_of(_all_of([query, _of_strings(run)]) for query, run in ends))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
                query, run = walk(arg[2], {""})
                if query is None and not any(CUT in s for s in run):
                    strings = run | {""}
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                query, run = walk(arg[2], {""})
                closed.append(_all_of([query, _of_strings(run)]))
            elif op is sre.AT:
                continue
            joined = {a + b for a in runs for b in strings or ()}
            if strings is None or len(joined) > MAX_STRINGS:
                closed.append(_of_strings(runs))
                joined = {CUT + s for s in strings or {""}}
            runs = joined
        return _all_of(closed), runs

    query, runs = walk(sre_parser.parse(pattern, flags), {""})
    return _all_of([query, _of_strings(runs)])


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def candidates(query, postings: dict[str, set[int]], everything: set[int]) -> set[int]:
    if query is None:
        return everything
    if isinstance(query, str):
        return postings[query]
    sets = [candidates(q, postings, everything) for q in query[1]]
    return set.intersection(*sets) if query[0] == "and" else set.union(*sets)


def index_block(texts: list[str], asked: set[str]) -> dict[str, set[int]]:
    """Postings: for each trigram asked for, the places of the texts that hold it, lower-cased.

    The index is over bytes of UTF-8; a trigram of longer characters is held by the texts that
    hold all trigrams of its bytes, which may be a few more.
    """
    parts = {g: [int.from_bytes(w[i:i + 3], "big") for i in range(len(w) - 2)] for g in asked for w in [g.encode("utf-8", "surrogatepass")]}
    codes = np.array(sorted({c for p in parts.values() for c in p}), np.uint32)
    if not len(codes):
        return {g: set() for g in asked}
    slot = lambda c: (c * np.uint32(0x9E3779B1)) >> np.uint32(16)
    wanted = np.zeros(1 << 16, bool)
    wanted[slot(codes)] = True
    folded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(f) + len(BETWEEN) for f in folded])
    data = np.frombuffer(BETWEEN.join(folded), np.uint8)
    del folded
    pairs = []
    for a in range(0, len(data) - 2, STEP):
        w = data[a:a + STEP + 2].astype(np.uint32)
        grams = w[:-2] << np.uint32(16) | w[1:-1] << np.uint32(8) | w[2:]
        at = np.flatnonzero(wanted[slot(grams)])
        place = np.minimum(np.searchsorted(codes, grams[at]), len(codes) - 1)
        hit = codes[place] == grams[at]
        pairs.append(np.unique(place[hit] * len(texts) + np.searchsorted(ends, a + at[hit], "right")))
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    cuts = np.searchsorted(pairs, np.arange(len(codes) + 1) * len(texts))
    lists = {int(c): set((pairs[i:j] % len(texts)).tolist()) for c, i, j in zip(codes, cuts, cuts[1:])}
    return {g: set.intersection(*(lists[c] for c in p)) for g, p in parts.items()}


def find_spans(texts: list[str], rules=RULES) -> list[list[tuple[int, int, int]]]:
    """For each text of a block, (start, place of the rule, end) of every secret, sorted."""
    found = [[] for _ in texts]
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    everything = set(range(len(texts)))
    postings = index_block(texts, set().union(*map(trigrams_of, queries)))
    for place, (rule, query) in enumerate(zip(rules, queries)):
        search = re.compile(rule.pattern, rule.flags).finditer
        for i in candidates(query, postings, everything):
            for m in search(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(rule.span), place, m.end(rule.span)))
    for spans in found:
        spans.sort()
    return found


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Per row: doc and found, an array of (kind, start, end), code points, end exclusive.

    Null and empty texts hold nothing; repeated rows are scanned each; other columns are
    not read.
    """
    def scan(batches):
        kinds = [r.kind for r in rules]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in found] for found in find_spans(texts, rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct(
                [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc", "found"])

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(
        scan, f"doc {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.withColumnRenamed("doc", doc)


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", rules=RULES) -> DataFrame:
    """The rows with every secret cut out of the text; other texts stay as they are.

    `length`, if it is a column, is set to the new text's code points where a text changed.
    """
    names, at = docs.columns, docs.columns.index(text)
    count = names.index(length) if length in names else None

    def clean(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redact(t, s) if s else t for t, s in zip(texts, find_spans([t or "" for t in texts], rules))]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                columns[count] = pa.array([len(n) if n is not o and n != o else c for n, o, c in
                                           zip(new, texts, columns[count].to_pylist())], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)

