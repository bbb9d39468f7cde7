"""PII surrogate generation: detected entities get keyed replacements of the same type, gender, script and format.

Detected: e-mail addresses (domains in any script), IPv4 and IPv6 addresses, card-like numbers (13 to 19 digits), bank
account numbers (country, two check digits), phone numbers, numbers of the form 000-00-0000, and names after a form of
address; the words of such a name are then found in the same text without it as well, in every case with a capital. An entity is known by its kind and
*canonical form* (digits of a number, lower case of an address or name), so its spellings corefer, under whichever title.
Each distinct entity of the corpus gets one canonical surrogate, drawn by HMAC-SHA256 under the caller's key:

* digits stay digits of their script (an entity's spellings in different digits corefer), letters stay letters of their
  script and case, separators, hyphens and apostrophes stay where each spelling has them;
* card numbers keep their first digit and whether they pass the Luhn check, bank accounts pass theirs if they did; phone
  numbers keep their country code (without one, or with ``HOME_CODE``, they are the same number); private, loopback and
  link-local addresses stay so;
* domains and surnames are entities of their own: equal ones stay equal in different addresses and names, the top-level
  domain stays; feminine forms of Slavic surnames agree with the masculine ones; a given name has the gender that most of
  its forms of address in the corpus tell (feminine surrogates end in a vowel, masculine ones in a consonant).

Collision checks run over the whole corpus as joins: no two entities of a kind share a surrogate, and none is an entity
that the corpus itself holds; losers are drawn again under the next counter, and words grow longer with it. So distinctness
and coreference hold. It raises if a kind of fixed length has more entities than forms.

Only texts that may hold an entity (a built-in regular expression) are shuffled, to meet their surrogates; the others
pass by. Null and empty texts pass unchanged. Rows that repeat, ties in gender (neither is then told) and null ids are
handled alike on every run: repeated rows get equal replacements. An empty table gives no rows. Other columns pass through,
but for ``n_entities``, which is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from countloom.llm.common import private
from countloom.session import cut

#: Forms of address by the gender that they tell (fixed values).
TITLES = {"m": "Mr Herr Señor Sr Monsieur Господин".split(), "f": "Mrs Ms Miss Frau Señora Sra Señorita Madame Mme Mlle Госпожа".split(), "x": "Dr Prof Mx".split()}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: The decimal digits of all scripts that \d matches, by value: they stand in runs from 0 to 9.
_VALUE = {c: i % 10 for run in regex.findall(r"\d+", "".join(map(chr, range(0x110000)))) for i, c in enumerate(run)}
_ASCII = {ord(c): str(v) for c, v in _VALUE.items()}
_is = lambda *values: f"[{''.join(c for c, v in _VALUE.items() if v in values)}]"
_OCTET = rf"(?:{_is(2)}{_is(5)}{_is(*range(6))}|{_is(2)}{_is(*range(5))}\d|{_is(1)}?\d?\d)"
#: A word of a name; a possessive ending is none of it.
_NAME = r"\p{Lu}(?:\p{L}+|(?=['’]))(?:[-'’](?!s\b)\p{L}+)*"
PATTERN = regex.compile(
    r"(?P<email>[^\W_][\w.+-]*+@(?P<domain>[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)+))"
    rf"|(?<![\w.])(?P<ip>(?:{_OCTET}\.){{3}}{_OCTET})(?![\d]|\.\d)"
    r"|(?<![\w:.])(?P<ipv6>(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39})(?![\w:.])"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,4})?)(?!\w)"
    r"|(?<![\w.])(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?<![\w.])(?P<phone>(?:(?P<code>\+?\d{1,3})[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4})(?!\d)"
    r"|(?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    rf"|\b(?:(?P<title>{'|'.join(_GENDER)})\.? )(?P<name>{_NAME}(?: {_NAME}){{0,2}})"
)
#: The country code that phone numbers without one have.
HOME_CODE = "1"
#: What a text with an entity holds at least, for the scan by Spark: a digit of any script, an @, two colons, a form of address.
#: Cn stands for digits and capitals that Java's tables are too old to know.
TRIGGER = rf"[0-9@\p{{Nd}}\p{{Cn}}]|::|:[A-Fa-f]+:|[{''.join(sorted({t[0] for t in _GENDER}))}](?<=(?:^|\W).)(?:{'|'.join(sorted({t[1:] for t in _GENDER}))})\.? [\p{{Lu}}\p{{Cn}}]"
DIGITS = ("card", "phone", "ssn")
#: Beginnings of addresses that are not public (fixed values); 172.16 to 172.31 are told apart.
PRIVATE = ("10.", "192.168.", "127.", "169.254.")


def _digits(s: str) -> str:
    return "".join(str(_VALUE[c]) for c in s if c in _VALUE)


def _as(digit: str, original: str) -> str:
    """A digit in the script of ``original``; other characters as they are."""
    return chr(ord(original) - _VALUE[original] + int(digit)) if digit in "0123456789" and original in _VALUE else digit


def _surname(word: str) -> str:
    """Lower case, and the masculine form of a Slavic surname."""
    low = word.lower().replace("’", "'")
    return low[:-1] if regex.search(r"\p{L}{2}(?:[оеё]в|ин)а$|\p{L}{2}(?:[oe]v|in)a$", low) else low


def entities(text: str) -> Iterator[tuple[str, str, int, int, str]]:
    """(kind, canonical form, start, end, gender that a form of address tells or x) of all entities, in order."""
    found, people = [], {}
    for m in PATTERN.finditer(text):
        kind = next(k for k in ("email", "ip", "ipv6", "iban", "card", "phone", "ssn", "name") if m[k])
        if kind == "email":
            at = m.start("domain")
            found.append(("local", m["email"].lower(), m.start(), at - 1, "x"))
            host, _, top = m["domain"].rpartition(".")
            found.append(("domain", host.lower(), at, at + len(host), "x"))
        elif kind == "name":
            at, words = m.start("name"), m["name"].split(" ")
            for i, w in enumerate(words):
                one = ("surname", _surname(w)) if i == len(words) - 1 else ("given", w.lower().replace("’", "'"))
                found.append((*one, at, at + len(w), _GENDER[m["title"]] if one[0] == "given" else "x"))
                if len(w) > 1:
                    people.setdefault(w.lower().replace("’", "'"), one[:2])
                at += len(w) + 1
        elif kind == "ipv6":
            try:
                found.append((kind, ipaddress.IPv6Address(m[kind]).exploded, *m.span(kind), "x"))
            except ValueError:
                pass  # hours and minutes, for example
        elif kind == "phone":
            code = _digits(m["code"] or "")
            found.append((kind, ("" if code in ("", HOME_CODE) else f"+{code}:") + _digits(m[kind])[-10:], *m.span(kind), "x"))
        elif kind in DIGITS:
            found.append((kind, _digits(m[kind]), *m.span(kind), "x"))
        else:
            found.append((kind, m[kind].replace(" ", "").translate(_ASCII), *m.span(kind), "x"))
    if people:  # the same words elsewhere in the text
        taken = sorted(x[2:4] for x in found)
        ends = [b for _, b in taken]
        words = "|".join(regex.escape(w).replace("'", "['’]") for w in sorted(people, key=len, reverse=True))
        for m in regex.finditer(rf"(?<![\w@.'’-])(?i:{words})(?![\w@]|[-'’](?!s\b)\p{{L}})", text):
            i, one = bisect_right(ends, m.start()), people.get(m[0].lower().replace("’", "'"))
            if one and m[0][0].isupper() and (i == len(taken) or taken[i][0] >= m.end()):  # any case but that of other words
                found.append((*one, *m.span(), "x"))
        found.sort(key=lambda x: x[2])
    yield from found


class _Stream:
    """Numbers from HMAC-SHA256 in counter mode."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.n, self.block = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        while True:
            if len(self.block) < 4:
                self.block = hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
                self.n += 1
            x, self.block = int.from_bytes(self.block[:4], "big"), self.block[4:]
            if x < (1 << 32) // n * n:
                return x % n


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


#: Consonants and vowels from which names are made (fixed values).
_SCRIPTS = {"LATIN": ("bdfglmnprstv", "aeio"), "CYRILLIC": ("бвгдзклмнрст", "аеио"), "GREEK": ("βγδκλμνπρστ", "αειο")}


def _script(word: str) -> str:
    """The first word of the Unicode name of the first letter: LATIN, HEBREW, CJK ..."""
    return unicodedata.name(word[0], "LATIN").partition(" ")[0]


@lru_cache(maxsize=4096)
def _letters(c: str) -> str:
    """Letters like ``c``: of its script and kind, from the same 256 places of Unicode."""
    first = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == unicodedata.category(c) and _script(x) == _script(c))


def canonical_surrogate(key: bytes, kind: str, value: str, attempt: int, gender: str = "x") -> str:
    """The ``attempt``-th draw for an entity."""
    s = _Stream(key, kind, value, attempt)
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        valid = [d for d in "0123456789" if luhn(body + d) == luhn(value)]
        return body + valid[s.below(len(valid))]
    if kind in DIGITS:
        return "".join(str(1 + s.below(9)) if c != "0" else str(s.below(10)) for c in value.rpartition(":")[2])
    if kind == "ip":
        kept = next((p for p in PRIVATE if value.startswith(p)), "")
        if regex.match(r"172\.(1[6-9]|2\d|3[01])\.", value):
            kept = f"172.{16 + s.below(16)}."
        return kept + ".".join(str(1 + s.below(254)) for _ in range(4 - kept.count(".")))
    if kind == "ipv6":
        kept = value[:4] if value[:2] in ("fc", "fd", "fe") else ""
        return ":".join([kept or f"2{s.below(1 << 12):03x}", *(f"{s.below(1 << 16):04x}" for _ in range(7))])
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in value[4:])
        number = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        check = f"{98 - number(body + value[:2] + '00'):02d}" if number(value[4:] + value[:4]) == 1 else f"{s.below(100):02d}"
        return value[:2] + check + body
    if kind in ("given", "surname"):
        if _script(value) not in _SCRIPTS:  # no syllables are known: letters alone
            return "".join(_letter(s, c) if c.isalpha() else c for c in value) + "".join(_letter(s, value[0]) for _ in range(attempt // 4))
        hard, soft = _SCRIPTS[_script(value)]

        def word(part: str) -> str:
            n = max(1 if len(part) < 3 else 2, min(5, len(part) // 2)) + attempt // 4
            return "".join(hard[s.below(len(hard))] + soft[s.below(len(soft))] for _ in range(n))

        out = "".join(x if x in "-'" else word(x) for x in regex.split(r"([-'])", value))
        return out[:-1] + soft[0] if gender == "f" else out + hard[s.below(len(hard))] if gender == "m" or kind == "surname" else out
    text = value.rpartition("@")[0] if kind == "local" else value
    out = "".join(_as(str(s.below(10)), c) if c.isdigit() else _letter(s, c) if c.isalpha() else c for c in text)
    return out + "".join(chr(97 + s.below(26)) for _ in range(attempt // 4))


def _letter(s: _Stream, c: str) -> str:
    script = _script(c)
    if script == "LATIN":
        return chr(97 + s.below(26))
    known = "".join(_SCRIPTS[script]) if script in _SCRIPTS else _letters(c)
    return known[s.below(len(known))]


def _like(surrogate: str, original: str) -> str:
    """Case of the original on a word surrogate, part by part."""
    if original.isupper() and len(original) > 1:
        return surrogate.upper()
    old, new = (regex.split(r"([-'’])", x) for x in (original, surrogate))
    if len(old) != len(new):
        return surrogate.capitalize() if original[:1].isupper() else surrogate
    return "".join(a if a in ("-", "'", "’") else b.capitalize() if a[:1].isupper() else b for a, b in zip(old, new))


def rendered(kind: str, surrogate: str, original: str) -> str:
    """The surrogate in the format of one spelling."""
    if kind == "surname" and _surname(original) != original.lower().replace("’", "'"):  # a feminine form
        surrogate += "а" if _script(original) == "CYRILLIC" else "a"
    if kind in ("local", "domain", "surname", "given"):
        return _like(surrogate, original)
    if kind == "ipv6":
        short = ipaddress.IPv6Address(surrogate).compressed if len(original) < 39 else surrogate
        return short.upper() if regex.search("[A-F]", original) else short
    if kind == "ip":
        octets = zip(surrogate.split("."), original.split("."))
        return ".".join("".join(_as(c, o[0]) for c in x) for x, o in octets)
    rest = list(surrogate)
    places = [i for i, c in enumerate(original) if c.isalnum() or c in _VALUE][-len(rest) :]
    out = list(original)
    for i, c in zip(places, rest):
        out[i] = _as(c, original[i])
    return "".join(out)


def surrogate_table(known: DataFrame, key: bytes, *, max_rounds: int = 64) -> DataFrame:
    """(kind, value, surrogate) of (kind, value, gender) without collisions, by repeated draws for the losers."""

    def drawer(attempt: int):
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind, value, gender = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([canonical_surrogate(key, k, v, attempt, g) for k, v, g in zip(kind, value, gender)], pa.string())], names=["kind", "value", "gender", "surrogate"])

        return draw

    # an address is taken if the corpus has it as a whole; local parts and numbers are compared as such
    own = F.when(F.col("kind") == "local", F.regexp_replace("value", "@.*$", "")).when(F.col("kind") == "phone", F.regexp_replace("value", "^.*:", "")).otherwise(F.col("value"))
    taken = cut(known.select("kind", own.alias("surrogate")).distinct(), "taken")
    done, open_ = None, known
    for attempt in range(max_rounds):
        drawn = cut(open_.select("kind", "value", "gender").mapInArrow(drawer(attempt), "kind string, value string, gender string, surrogate string"), "drawn")
        best = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        held = taken if done is None else taken.unionByName(done.select("kind", "surrogate"))
        won = cut(best.join(held, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        open_ = drawn.select("kind", "value", "gender").join(won.select("kind", "value"), ["kind", "value"], "left_anti")
        if open_.isEmpty():
            return done
    raise ValueError(f"a kind has too few surrogates: {open_.first()}")


@private("_key", "_map")
def replace(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity replaced by its surrogate, and ``n_entities`` (long)."""
    base = docs.drop("n_entities")
    may = F.coalesce(F.col(text_col).rlike(TRIGGER), F.lit(False))
    keyed = cut(base.where(may).withColumn("_key", F.xxhash64(id_col, text_col)), "suspects")  # a small part, read twice
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(k, *e[:2], e[4]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3))], names=["_key", "kind", "value", "gender"])

    # texts are few but costly to parse: they are dealt evenly first
    own = cut(keyed.select("_key", text_col).repartition(parts).mapInArrow(found, "_key long, kind string, value string, gender string"), "entities")
    tell = F.count_if(F.col("gender") == "f") - F.count_if(F.col("gender") == "m")
    known = own.groupBy("kind", "value").agg(tell.alias("t")).select("kind", "value", F.when(F.col("t") > 0, "f").when(F.col("t") < 0, "m").otherwise("x").alias("gender"))
    table = surrogate_table(cut(known, "known"), key)
    maps = own.select("_key", "kind", "value").join(table, ["kind", "value"]).groupBy("_key").agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("_map"))  # a text's own entities
    joined = keyed.join(maps, "_key", "left").drop("_key")
    schema = T.StructType([*base.schema.fields, T.StructField("n_entities", T.LongType())])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            maps = batch.column(batch.schema.get_field_index("_map")).to_pylist()
            for text, own in zip(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), maps):
                known = {(x["kind"], x["value"]): x["surrogate"] for x in own or ()}
                out, last, n = [], 0, 0
                for kind, value, a, b, _ in entities(text) if known else ():
                    out += [text[last:a], rendered(kind, known[kind, value], text[a:b])]
                    last = b
                    n += kind not in ("domain", "given")
                texts.append("".join([*out, text[last:]]))
                counts.append(n)
            old = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            yield pa.RecordBatch.from_pydict(old | {text_col: pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64())})

    return base.where(~may).withColumn("n_entities", F.lit(0).cast("long")).unionByName(joined.mapInArrow(run, schema))
