"""Text functions: tokens, Porter stems, search grammar, redaction, JSON rescue and small normalisers."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(role: Column, text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of role, NUL and text."""
    return F.substring(F.sha2(F.concat(role, F.lit("\0"), text).cast("binary"), 256), 1, 16)


def iso_from_epoch(seconds: Column) -> Column:
    """ISO 8601 in UTC; microseconds only where they are not zero."""
    at = F.timestamp_micros(F.round(seconds.cast("decimal(20,6)") * 1_000_000).cast("long"))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def normal_role(role: Column) -> Column:
    return F.when(role == "human", "user").otherwise(F.coalesce(role, F.lit("unknown")))


def project_name(slug: Column) -> Column:
    """Project part of a directory slug: without drive, Users or home, and the user's name."""
    short = F.regexp_replace(slug, r"^[A-Za-z]?-+(?:Users|home)-[^-]+-?", "")
    return F.when(short != "", short).otherwise(slug)


def ref_parts(ref: Column) -> tuple[Column, Column]:
    """(conv_key, native_id) of a reference conv_key#native_id."""
    return F.substring_index(ref, "#", 1), F.when(F.contains(ref, F.lit("#")), F.regexp_replace(ref, "^[^#]*#", ""))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


# Redaction -----------------------------------------------------------------------------------------------------

#: Name and pattern of each secret, in the order in which they are masked; group 1 is kept.
SECRETS = (
    ("bearer", r"(?i)(bearer\s+)[a-z0-9._\-]{16,}"),
    ("api-key", r"\b(sk|pk|rk)-[A-Za-z0-9_\-]{20,}\b"),
    ("github", r"\b()gh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("aws", r"\b()AKIA[0-9A-Z]{16}\b"),
    ("slack", r"\b()xox[baprs]-[A-Za-z0-9\-]{10,}\b"),
    ("hex-key", r"\b()[0-9a-f]{40,}\b"),
    ("pem", r"(?s)()-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("url-cred", r"(://[^/\s:]+):[^@/\s]+@"),
)


def known_secrets(raw: str) -> list[str]:
    """Entries of a list of known secrets longer than eight characters: a JSON object's strings, or lines without #."""
    try:
        data = json.loads(raw)
    except ValueError:
        data = None
    found = [v for v in data.values() if isinstance(v, str)] if isinstance(data, dict) else [x.strip() for x in raw.splitlines() if not x.strip().startswith("#")]
    return [x for x in found if len(x) > 8]


#: Texts of which one stands in every match of a pattern; a search for them is much cheaper than the pattern.
ANCHORS = {"api-key": ("sk-", "pk-", "rk-"), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "aws": ("AKIA",), "slack": ("xox",), "pem": ("-----BEGIN ",), "url-cred": ("://",)}


def may_hold(text: Column, name: str) -> Column:
    """False only for texts without a match of the named pattern."""
    out = F.lit(name not in ANCHORS)
    for anchor in ANCHORS.get(name, ()):
        out = out | F.contains(text, F.lit(anchor))
    return out


def redact(text: Column, known: list[str] = ()) -> Column:
    """Mask known secrets, then each pattern in turn; an earlier mask can change what a later one sees."""
    for secret in known:
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED:known-credential]"))
    for name, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"$1[REDACTED:{name}]")
    return text


#: Pieces of a JSON text: a key, a string, and what is between them.
JSON_PIECES = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'


def redact_json(text: Column, known: list[str] = ()) -> Column:
    """Mask the secrets in each string of a JSON text by itself, at any depth; keys, numbers and the form stay."""
    mask = lambda x: F.when(F.startswith(x, F.lit('"')) & ~F.endswith(x, F.lit(":")), redact(x, known)).otherwise(x)
    pieces = F.regexp_extract_all(text, F.lit(JSON_PIECES), F.lit(0))
    return F.when(has_secret(text, known), F.array_join(F.transform(pieces, mask), "")).otherwise(text)


def has_secret(text: Column, known: list[str] = ()) -> Column:
    """Whether ``redact`` would change a text: the first pattern that matches sees the text as it is."""
    found = F.lit(False)
    for secret in known:
        found = found | F.contains(text, F.lit(secret))
    for name, pattern in SECRETS:
        found = found | (may_hold(text, name) & text.rlike(pattern))
    return found


def redaction_counts(text: Column, known: list[str] = ()) -> Column:
    """Map from name to the number of masks in the redacted text that were not there before."""
    names = [n for n, _ in SECRETS] + (["known-credential"] if known else [])

    def counts(masked: Column) -> Column:
        marks = [(F.lit(n), F.lit(rf"\[REDACTED:{n}\]")) for n in names]
        pairs = [x for n, mark in marks for x in (n, F.regexp_count(masked, mark) - F.regexp_count(text, mark))]
        return F.map_filter(F.create_map(*pairs), lambda _, k: k > 0)

    # the variable of a lambda holds the masked text, so that it is made once
    return F.element_at(F.transform(F.array(redact(text, known)), counts), 1)


# Tokens --------------------------------------------------------------------------------------------------------


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, case folded and without diacritics."""
    if not text:
        return []
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain)


_VOWELS = "aeiou"


class Porter:
    """The Porter (1980) stemmer as rules over a stem's measure; words of one or two letters stay."""

    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def consonant(w: str, i: int) -> bool:
        return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and Porter.consonant(w, i - 1))

    @classmethod
    def measure(cls, w: str) -> int:
        shape = "".join("c" if cls.consonant(w, i) else "v" for i in range(len(w)))
        return len(re.findall("v+c+", shape))

    @classmethod
    def vowel(cls, w: str) -> bool:
        return any(not cls.consonant(w, i) for i in range(len(w)))

    @classmethod
    def double(cls, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cls.consonant(w, len(w) - 1)

    @classmethod
    def cvc(cls, w: str) -> bool:
        n = len(w)
        return n > 2 and cls.consonant(w, n - 1) and not cls.consonant(w, n - 2) and cls.consonant(w, n - 3) and w[-1] not in "wxy"

    @classmethod
    def replaced(cls, w: str, rules: dict[str, str]) -> str:
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                return stem + rules[end] if cls.measure(stem) > 0 else w
        return w

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: -len(end)] + new
                break
        if w.endswith("eed"):
            w = w[:-1] if cls.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and cls.vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif cls.double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif cls.measure(w) == 1 and cls.cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and cls.vowel(w[:-1]):
            w = w[:-1] + "i"
        w = cls.replaced(cls.replaced(w, cls.STEP2), cls.STEP3)
        for end in sorted(cls.STEP4, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                if cls.measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e"):
            m = cls.measure(w[:-1])
            if m > 1 or (m == 1 and not cls.cvc(w[:-1])):
                w = w[:-1]
        return w[:-1] if cls.measure(w) > 1 and cls.double(w) and w[-1] == "l" else w


#: Texts whose tokens are Python objects at a time, and stems that a worker remembers.
STEM_ROWS, STEM_WORDS = 256, 100_000


def stemmed_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stemmed tokens of texts, STEM_ROWS texts at a time; a word is stemmed once while it is remembered."""
    stems: dict[str, str] = {}
    for texts in batches:
        for at in range(0, max(len(texts), 1), STEM_ROWS):
            split = texts.iloc[at : at + STEM_ROWS].map(tokens)
            if len(stems) > STEM_WORDS:
                stems.clear()
            for w in {w for ws in split for w in ws}.difference(stems):
                stems[w] = Porter.stem(w)
            yield split.map(lambda ws: [stems[w] for w in ws])


def stemmed_tokens(text: Column) -> Column:
    """Stemmed tokens of each text; a worker holds the tokens of a few texts at a time, however long Arrow's batches are."""

    @F.pandas_udf("array<string>")
    def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from stemmed_batches(batches)

    return stemmed(text)


def plain_tokens(text: Column) -> Column:
    """Unstemmed runs of ASCII letters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


# Search grammar ------------------------------------------------------------------------------------------------


class QueryError(ValueError):
    """A query that the grammar rejects."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


_LEXEMES = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()*+,:^{}])|([^\s"()*+,:^{}]+))')


def parse_query(text: str, stem=Porter.stem, columns: tuple[str, ...] = ("text",)):
    """Tree of a full-text query: implicit AND, AND, OR, NOT, phrases, prefix *, NEAR(...), column filter.

    Barewords hold letters, digits, underscores and non-ASCII characters only; anything else raises QueryError.
    """
    items: list[tuple[str, str]] = []
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _LEXEMES.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:at + 1]!r}")
        at = m.end()
        if m[1] is not None:
            items.append(("string", m[1].replace('""', '"')))
        elif m[2]:
            items.append((m[2], m[2]))
        elif re.fullmatch(r"[A-Za-z0-9_\u001a\u0080-\U0010ffff]+", m[3]):
            items.append((m[3], m[3]) if m[3] in ("AND", "OR", "NOT") else ("word", m[3]))
        else:
            raise QueryError(f"syntax error near {m[3]!r}")
    pos = 0

    def peek(ahead: int = 0) -> str:
        return items[pos + ahead][0] if pos + ahead < len(items) else "end"

    def take(kind: str | None = None) -> str:
        nonlocal pos
        if peek() == "end" or kind and peek() != kind:
            raise QueryError(f"expected {kind}, found {peek()}")
        pos += 1
        return items[pos - 1][1]

    def phrase() -> Phrase:
        words = [stem(w) for w in tokens(take())]
        while peek() == "+":
            take("+")
            if peek() not in ("word", "string"):
                raise QueryError("expected a phrase after +")
            words += [stem(w) for w in tokens(take())]
        star = peek() == "*"
        if star:
            take("*")
        return Phrase(tuple(words), star)

    def primary():
        if peek() == "(":
            take("(")
            inner = either()
            take(")")
            return inner
        if peek() == "word" and items[pos][1] == "NEAR" and peek(1) == "(":
            take()
            take("(")
            parts, distance = [], 10
            while peek() in ("word", "string"):
                parts.append(phrase())
            if peek() == ",":
                take(",")
                number = take("word")
                if not number.isdigit():
                    raise QueryError("expected a number in NEAR")
                distance = int(number)
            take(")")
            return Near(tuple(parts), distance)
        if peek() == "word" and peek(1) == ":":
            name = take()
            take(":")
            if name not in columns:
                raise QueryError(f"no such column: {name}")
            return primary()
        if peek() in ("word", "string"):
            return phrase()
        raise QueryError(f"unexpected {peek()}")

    def implicit():
        left = primary()
        while peek() in ("word", "string", "("):
            left = Op("AND", left, primary())
        return left

    def chain(kind: str, inner):
        def parse():
            left = inner()
            while peek() == kind:
                take(kind)
                left = Op(kind, left, inner())
            return left

        return parse

    either = chain("OR", chain("AND", chain("NOT", implicit)))
    tree = either()
    if peek() != "end":
        raise QueryError(f"unexpected {peek()}")
    return tree


def phrases_of(tree) -> list[tuple[Phrase, Near | None]]:
    """All phrases of a query that score, with the NEAR group that restricts them; what NOT excludes does not score."""
    if isinstance(tree, Phrase):
        return [(tree, None)] if tree.words else []
    if isinstance(tree, Near):
        return [(p, tree) for p in tree.phrases if p.words]
    return phrases_of(tree.left) + (phrases_of(tree.right) if tree.kind != "NOT" else [])


def query_words(tree) -> tuple[list[str], list[str]]:
    """Whole words and word beginnings that a query looks at, those that NOT excludes included."""
    if isinstance(tree, Op):
        (a, b), (c, d) = query_words(tree.left), query_words(tree.right)
        return list(dict.fromkeys(a + c)), list(dict.fromkeys(b + d))
    phrases = [p for p in (tree.phrases if isinstance(tree, Near) else (tree,)) if p.words]
    whole = [w for p in phrases for w in (p.words[:-1] if p.prefix else p.words)]
    return list(dict.fromkeys(whole)), list(dict.fromkeys(p.words[-1] for p in phrases if p.prefix))


def query_tokens(doc: Column, tree) -> Column:
    """Of an array of tokens those that a query looks at, with their places (from 1): w, at."""
    whole, begins = query_words(tree)

    def wanted(x: Column) -> Column:
        out = x["w"].isin(*whole) if whole else F.lit(False)
        for b in begins:
            out = out | F.startswith(x["w"], F.lit(b))
        return out

    return F.filter(F.transform(doc, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("at"))), wanted)


def phrase_starts(found: Column, p: Phrase) -> Column:
    """Places at which a phrase begins, from the tokens that ``query_tokens`` kept; by set operations, so in linear time."""

    def places(k: int) -> Column:
        word = p.words[k]
        test = (lambda x: F.startswith(x["w"], F.lit(word))) if p.prefix and k == len(p.words) - 1 else (lambda x: x["w"] == word)
        return F.transform(F.filter(found, test), lambda x: x["at"] - k)

    starts = places(0)
    for k in range(1, len(p.words)):
        starts = F.array_intersect(starts, places(k))
    return starts


def scored_starts(found: Column, p: Phrase, near: Near | None) -> Column:
    """Places of a phrase that count: within a NEAR group those close to each of the other phrases."""
    starts = phrase_starts(found, p)
    for q in [q for q in near.phrases if q.words and q is not p] if near else []:
        starts = _close(starts, phrase_starts(found, q), p, q, near.distance)
    return starts


#: Distance of a NEAR group up to which all places in reach are listed; beyond, places are compared in pairs.
LISTED_DISTANCE = 64


def _close(starts: Column, others: Column, p: Phrase, q: Phrase, distance: int) -> Column:
    """Places of phrase p with at most ``distance`` tokens between them and some place of phrase q."""
    if distance <= LISTED_DISTANCE:
        return F.array_intersect(starts, F.flatten(F.transform(others, lambda j: F.sequence(j - distance - len(p.words), j + distance + len(q.words)))))
    return F.element_at(F.transform(F.array(others), lambda o: F.filter(starts, lambda i: F.exists(o, lambda j: (j >= i - distance - len(q.words)) & (j <= i + distance + len(p.words))))), 1)


def matches(found: Column, tree) -> Column:
    """Whether a document, by the tokens that ``query_tokens`` kept of it, satisfies a query; a phrase without tokens does not restrict."""
    if isinstance(tree, Phrase):
        return F.size(phrase_starts(found, tree)) > 0 if tree.words else F.lit(True)
    if isinstance(tree, Near):
        parts = [p for p in tree.phrases if p.words]
        return F.size(scored_starts(found, parts[0], tree)) > 0 if parts else F.lit(True)
    left, right = matches(found, tree.left), matches(found, tree.right)
    return {"AND": left & right, "OR": left | right, "NOT": left & ~right}[tree.kind]


# JSON rescue ---------------------------------------------------------------------------------------------------


def rescue_json(text: str | None, opening: str = "{") -> str | None:
    """The first balanced JSON object (or array) in a model's answer that parses; brackets in strings do not count."""
    text = text or ""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening)
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if not depth:
                    try:
                        json.loads(text[start : i + 1])
                        return text[start : i + 1]
                    except ValueError:
                        break
        start = text.find(opening, start + 1)
    return None


def rescued(text: Column, opening: str = "{") -> Column:
    """The JSON value that each answer holds, in Arrow batches."""

    @F.pandas_udf("string")
    def rescue(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rescue_json(t, opening))

    return rescue(text)
