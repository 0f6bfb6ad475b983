"""Secret scanning: fixed patterns and the compressed novelty of strings in a sensitive context.

A candidate string is priced by what it adds to a zstandard frame: the frame of
the code around it and the string, less the frame of that code alone, both primed
with a dictionary of common identifiers. Identifiers, paths and repeated values
compress well; random keys don't. Candidates near a word such as ``key`` or
``auth``, on their line or the one before, whose price per character reaches a
threshold are reported. An assignment without quotes or blanks is priced as a
whole, then by its parts. The body of a private key in PEM form is one candidate.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import ready

#: The kinds of spans in the order that breaks ties.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # as runs of 32 or more among all runs

#: Words that make a context sensitive, and identifiers that code uses anyway.
CONTEXT_WORDS = ("api", "auth", "bearer", "cert", "client", "credential", "key", "passphrase", "passwd", "password", "private", "pwd", "salt", "secret", "session", "sig", "token", "webhook")
IDENTIFIERS = """
abstract access_key account api_key apikey application argument array assert async auth authorization await base64
basic bearer boolean break bucket buffer callback case catch certificate char class client client_id client_secret
config connection console const constructor content context continue cookie credential credentials database debug
default define delete description document double else email encoding endpoint environment error example exception
export extends false file filename final finally float format function get_token getattr github global hash header
headers host hostname http https import include index info init input instance int integer interface json key lambda
length license list local localhost login long main manager message method model module name namespace new none null
number object option output override package parameter params parent parser pass passphrase password path payload port
postgres print private private_key property protected protocol public python query raise range read redirect refresh
region register request require reset resource response result return return_url root route schema secret secret_key
select self send server service session session_id set setting signature size source split sql ssh static status
string struct super switch table target template test this throw timeout timestamp token tokens true type typedef
undefined unsigned update upload url user user_id username utf8 value values variable vector version void volatile
webhook while with write yield 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ www.example.com
"""
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_words = "|".join(CONTEXT_WORDS)
_Title = "|".join(w.capitalize() for w in CONTEXT_WORDS)
#: A word, or several without a gap, from a border on: no letter before, or a capital after other letters (apiKey, mySECRET).
_SENSITIVE = re.compile(
    rf"(?<![A-Za-z])(?i:{_words})+(?=[sS]|[^A-Za-z]|\Z)"
    rf"|(?<![A-Za-z])(?:{_words}|{_Title})(?=[A-Z])"
    rf"|(?<=[A-Za-z])(?:{_Title})(?=s|[^a-z]|\Z)"
    rf"|(?<=[a-z])(?:{_words.upper()})(?=[sS]|[^A-Za-z]|\Z)"
)
#: Where the parts of a candidate begin. Signs at its end are padding.
_PART = re.compile(r"(?<=[^=])=+(?=[^=])")
#: The body of a private key: headers, then long runs of base64, the last of any length if the end mark follows.
_PEM = re.compile(
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[nr])*+(?:[A-Za-z-]{1,40}: [^\n\\]*+(?:\s|\\[nr])++)*+"
    r"((?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]++(?=(?:\s|\\[nr])*+-----END))?)"
)
_AROUND, _NEAR = 256, 48
#: Up to so many characters the compressor can't code letters by their frequency, so random ones cost a byte each.
_SHORT, _SHORT_PRICE = 64, 0.9


class Novelty:
    """Prices strings in zstandard bytes."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard

        # Content-only: frames refer to the dictionary's bytes, with neither checksum nor sizes to blur the price.
        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(9, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.size = lambda data, f=zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress: len(f(data))

    def price(self, text: str, start: int, end: int) -> int:
        """Marginal bytes of ``text[start:end]`` after the characters before and after it."""
        around = (text[max(0, start - _AROUND) : start] + "\n" + text[end : end + _AROUND] + "\n").encode()
        return max(0, self.size(around + text[start:end].encode()) - self.size(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, per_char: float) -> list[tuple[int, int, int]]:
    """Candidates that no base span overlaps, in a sensitive context and priced at ``per_char`` bytes or more a character, short ones at 0.9 or more.

    The context is what comes before on the line, up to 48 characters, and the end
    of the last line before that isn't blank, up to 256. Bodies of private keys
    need no other context and may overlap base spans.
    """
    out = []
    if not _SENSITIVE.search(text):
        return out
    dear = lambda s, e: novelty.price(text, s, e) >= (per_char if e - s > _SHORT else max(per_char, _SHORT_PRICE)) * (e - s)
    if "-----BEGIN " in text:
        out = [(m.start(1), m.end(1), 3) for m in _PEM.finditer(text) if m[1] and dear(*m.span(1))]
    taken, at = sorted(base + out), 0
    line = seen = 0

    def sensitive(s):
        if _SENSITIVE.search(text, max(line, s - _NEAR), s):
            return True
        before = text[max(0, line - _AROUND) : line].rstrip()
        return bool(_SENSITIVE.search(before, before.rfind("\n") + 1))

    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        line = max(line, text.rfind("\n", seen, s) + 1)
        seen = s
        spans = [(s, e)]
        if "=" in m[0]:
            cuts = [c.span() for c in _PART.finditer(text, s, e)]
            if cuts:
                spans += zip([s, *(c[1] for c in cuts)], [*(c[0] for c in cuts), e], strict=True)
        for i, (x, y) in enumerate(spans):
            word = text[x:y]
            if y - x < 16 or not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
                continue
            if any(b[0] < y and b[1] > x for b in itertools.takewhile(lambda b: b[0] < y, itertools.islice(taken, at, None))):
                continue
            if sensitive(x) and dear(x, y):
                out.append((x, y, 3))
                if i == 0:
                    break
    return sorted(out)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, text: str = "text", spans: str = "secret_spans", per_char: float = 0.6, redact: str | None = None) -> DataFrame:
    """All columns of ``df`` and ``spans``: array of (kind, start, end, price) by start, then kind.

    Places are code points, ends exclusive; ``price`` is the span's marginal
    compressed bytes. A null or empty text has an empty array. With ``redact``,
    each run of spans in the text is replaced by that mark instead and ``spans``
    isn't added; null texts stay null. ``per_char`` is the least price a character
    of a reported candidate. An input column named as ``spans`` is replaced.
    """
    import pyarrow as pa

    ready(df.sparkSession)
    df = df if redact is not None else df.drop(spans)
    where = df.columns.index(text)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("price", pa.int32())])

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            texts = batch.column(where).to_pylist()
            found = []
            for x in texts:
                base = base_spans(x or "")
                found.append(sorted(base + novel_spans(x or "", base, novelty, per_char), key=lambda s: (s[0], s[2])))
            columns = list(batch.columns)
            if redact is not None:
                columns[where] = pa.array([x if not f else redacted(x, f, redact) for x, f in zip(texts, found, strict=True)], columns[where].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            else:
                values = [[{"kind": KINDS[k], "start": s, "end": e, "price": novelty.price(x, s, e)} for s, e, k in f] for x, f in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.list_(item))], names=[*batch.schema.names, spans])

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("price", T.IntegerType())]))
    return df.mapInArrow(run, df.schema if redact is not None else T.StructType([*df.schema.fields, T.StructField(spans, kind)]))
