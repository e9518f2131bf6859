"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, scheme separators, plus
signs before a digit, digits, and cues such as ``token`` or ``passport``. Around an anchor a
small deterministic parser expands to both sides and validates what it finds. No text is
scanned by a backtracking expression, and what a parser has scanned is remembered where the
next anchor could scan it again, so a text costs time in proportion to its length. A very long
text is scanned whole, and takes memory for itself and a lower-case copy.

Base kinds (email, ip, card, phone) are exactly the leftmost non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)         parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                          14 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                      10 to 15 digits

where a match that fails its check is dropped and not retried. Further kinds come from
cues: ``login`` (user:password in a URL), ``iban`` (valid by modulus 97), ``account`` and ``secret``
(the value after an identifier cue); and from base matches that failed since they ran into
further digits: ``pan`` (a card number within a longer chain) and ``tel`` (the telephone number at its
beginning).
"""

from __future__ import annotations

import string
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import out_of_the_way, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("login", "iban", "account", "secret", "pan", "tel")
KINDS = BASE_KINDS + ADDED_KINDS
RANK = {k: i for i, k in enumerate(KINDS)}

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
VALUE = ALNUM | frozenset("_-.+/=")
BLANKS = frozenset(" \t")
CAPITALS = DIGITS | frozenset(string.ascii_uppercase)

# Words that announce an identifier or a secret, in lower case.
ACCOUNT_CUES = ("account number", "account no", "passport", "social security", "ssn", "tax id", "customer id", "member id", "iban")
SECRET_CUES = ("api_key", "api-key", "apikey", "access_key", "secret", "password", "passwd", "token", "bearer")
MIN_VALUE = 8


@lru_cache(maxsize=1)
def _automaton():
    """Anchors over a text in ASCII lower case; a value says what to parse."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for d in string.digits:
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("plus", 2))
    for cue in ACCOUNT_CUES:
        a.add_word(cue, ("account", len(cue)))
    for cue in SECRET_CUES:
        a.add_word(cue, ("secret", len(cue)))
    a.make_automaton()
    return a


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _run(text: str, i: int, allowed: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(text, at + 1, LABEL)
    if end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, dots = after, dots + 1
    return (start, end) if dots else None


def _dotted(text: str, start: int) -> tuple[list[int], int]:
    """Ends of the digit runs of a chain like 1.2.3 and its end."""
    ends, end = [], _run(text, start, DIGITS)
    ends.append(end)
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        end = _run(text, end + 1, DIGITS)
        ends.append(end)
    return ends, end


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _card_end(text: str, start: int) -> int:
    end, n = start + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    """Greedy run after '+d' cut back to its last digit; at least one character between."""
    end = _run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 and text[end - 1] in DIGITS else None


def _cards_within(text: str, start: int, end: int):
    """Unbroken runs of 14 to 19 digits that pass Luhn, in a chain of digits, blanks and hyphens."""
    while start < end:
        stop = _run(text, start, DIGITS)
        if 14 <= stop - start <= 19 and luhn(text[start:stop]):
            yield start, stop
        start = stop + 1


def _phone_head(text: str, start: int, end: int) -> int | None:
    """Where a telephone number ends that runs into more digits: after 11 digits for country code 1,
    else after the last group of digits that keeps it at 15 or fewer."""
    n, best, i = 0, None, start
    while i < end:
        if text[i] not in DIGITS:
            i += 1
            continue
        stop = _run(text, i, DIGITS)
        n += stop - i
        if n > 15:
            break
        if n >= 10:
            best = stop
        if n == 11 and text[start + 1] == "1" and text[start + 2] not in DIGITS:
            return stop
        i = stop
    return best


def _iban(text: str, digit: int) -> tuple[int, int] | None:
    """Two capitals, two digits, 11 to 30 capitals or digits in groups parted by blanks; modulus 97."""
    start = digit - 2
    if start < 0 or not all("A" <= c <= "Z" for c in text[start:digit]) or start and text[start - 1] in ALNUM:
        return None
    head, end, kept, best, rest = 0, start, 0, None, 0
    while kept < 34 and end < len(text):
        c = text[end]
        if c in CAPITALS:
            # the first four characters count as if they stood last
            worth, width = int(c, 36), 10 if c in DIGITS else 100
            if kept < 4:
                head = head * width + worth
            else:
                rest = (rest * width + worth) % 97
            kept += 1
            end += 1
            if kept == 4 and not text[digit : digit + 2].isdigit():
                return None
            if kept >= 15 and (rest * 1_000_000 + head) % 97 == 1 and (end == len(text) or text[end] not in ALNUM):
                best = end
        elif c == " " and end + 1 < len(text) and text[end + 1] in CAPITALS:
            end += 1
        else:
            break
    return (start, best) if best else None


def _login(text: str, after: int) -> tuple[int, int] | None:
    """user:password of scheme://user:password@host."""
    stop = after
    while stop < len(text) and text[stop] not in "/?# \t\r\n\"'<>":
        stop += 1
    at = text.rfind("@", after, stop)
    return (after, at) if at > after and ":" in text[after:at] else None


class _Values:
    """Runs of value characters in one text. A run is scanned once, however many cues stand in it."""

    def __init__(self, text: str):
        self.text, self.start, self.stop, self.last, self.digit = text, 0, 0, 0, -1

    def end(self, i: int) -> tuple[int, bool]:
        """Where the value that begins at ``i`` ends, without trailing stops, hyphens and slashes, and
        whether a digit is in it."""
        if not self.start <= i < self.stop:
            text, self.start, self.stop = self.text, i, _run(self.text, i, VALUE)
            self.last = self.stop
            while self.last > i and text[self.last - 1] in ".-/":
                self.last -= 1
            self.digit = self.last - 1
            while self.digit >= i and text[self.digit] not in DIGITS:
                self.digit -= 1
        return max(i, self.last), self.digit >= i


def _value(text: str, after: int, needs_mark: bool, values: _Values) -> tuple[int, int] | None:
    """The value after a cue: blanks, at most one of : = #, blanks, a quote, then at least
    MIN_VALUE characters with a digit among them."""
    i = after
    if i < len(text) and text[i] in "\"'":
        i += 1
    i = _run(text, i, BLANKS)
    mark = i < len(text) and text[i] in ":=#"
    if mark:
        i = _run(text, i + 1, BLANKS)
    elif needs_mark:
        return None
    if i < len(text) and text[i] in "\"'":
        i += 1
    end, digit = values.end(i)
    return (i, end) if digit and end - i >= MIN_VALUE else None


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind in KINDS' order."""
    if not text:
        return []
    spans, values = [], _Values(text)
    done = dict.fromkeys(("email", "chain", "card", "phone", "added"), 0)

    def added(span, kind):
        if span and span[0] >= done["added"]:
            done["added"] = span[1]
            spans.append((*span, kind))

    for last, (what, size) in _automaton().iter(text.translate(_LOWER)):
        first = last - size + 1
        if what == "digit":
            if first >= done["card"]:
                end = _card_end(text, first)
                done["card"] = end
                digits = [c for c in text[first:end] if c in DIGITS]
                if 14 <= len(digits) <= 19 and luhn("".join(digits)):
                    spans.append((first, end, "card"))
                elif len(digits) > 19:
                    spans += [(a, b, "pan") for a, b in _cards_within(text, first, end)]
            if first >= done["chain"]:
                ends, done["chain"] = _dotted(text, first)
                start = first
                for k in range(3, len(ends), 4):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[start : ends[k]].split(".")):
                        spans.append((start, ends[k], "ip"))
                    start = ends[k] + 1
            if first >= 2 and "A" <= text[first - 1] <= "Z":
                added(_iban(text, first), "iban")
        elif what == "at":
            if span := _email(text, first, done["email"]):
                done["email"] = span[1]
                spans.append((*span, "email"))
        elif what == "plus":
            if first >= done["phone"] and (span := _phone(text, first)):
                done["phone"] = span[1]
                digits = sum(c in DIGITS for c in text[span[0] : span[1]])
                if 10 <= digits <= 15:
                    spans.append((*span, "phone"))
                elif digits > 15 and (end := _phone_head(text, *span)):
                    spans.append((first, end, "tel"))
        elif what == "scheme":
            added(_login(text, last + 1), "login")
        elif first == 0 or text[first - 1] not in ALNUM:
            added(_value(text, last + 1, what == "secret", values), what)
    spans.sort(key=lambda s: (s[0], RANK[s[2]], s[1]))
    return spans


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every span, overlapping ones together, replaced by its kind in angle brackets."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def _columns(df: DataFrame, added: tuple[str, ...]) -> tuple[list[str], str]:
    keep = [c for c in df.columns if c not in added]
    return keep, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def annotate(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``pii``: array of (start, end, kind), by start, then kind.

    Null and empty texts have no spans. Rows are annotated one by one, repeated or not;
    a column of ``docs`` called pii is replaced."""
    out_of_the_way(docs, text)
    small_batches(docs.sparkSession)
    keep, fields = _columns(docs, ("pii",))
    at = keep.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in find(x.as_py())] for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*keep, "pii"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{fields}, pii array<struct<start:bigint,end:bigint,kind:string>>")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; other columns as they are."""
    out_of_the_way(docs, text)
    small_batches(docs.sparkSession)
    keep, fields = _columns(docs, ())
    at = keep.index(text)

    def run(batches):
        for batch in batches:
            texts = [mask(x, find(x)) for x in (v.as_py() for v in batch.column(at))]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=keep)

    return docs.mapInArrow(run, fields)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pii_report(docs)


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the spans."""
    found = annotate(docs).drop("text")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))
