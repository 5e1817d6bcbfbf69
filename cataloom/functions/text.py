"""Search-term handling: the blank test, LIKE escapes and case/accent folding."""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's String.prototype.trim removes
# (WhiteSpace and LineTerminator code points).
JS_WHITESPACE = ("\t\n\v\f\r \u00a0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000\ufeff")

INSENSITIVE, BINARY = "insensitive", "binary"


def blank(term: str | None) -> bool:
    """True when a search input adds no condition (missing or only whitespace)."""
    return term is None or term.strip(JS_WHITESPACE) == ""


def clean_escapes(term: str) -> str:
    """Make a user term a valid Spark LIKE body with MySQL's escape meaning:
    ``\\%``, ``\\_`` and ``\\\\`` stay escapes, a backslash before any other
    character is dropped, a trailing lone backslash is a literal backslash."""
    out, i = [], 0
    while i < len(term):
        ch = term[i]
        if ch == "\\":
            if i + 1 == len(term):
                out.append("\\\\")
            elif term[i + 1] in "%_\\":
                out.append(term[i:i + 2])
                i += 1
            else:
                out.append(term[i + 1])
                i += 1
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def has_wildcard(cleaned: str) -> bool:
    i = 0
    while i < len(cleaned):
        if cleaned[i] == "\\":
            i += 2
            continue
        if cleaned[i] in "%_":
            return True
        i += 1
    return False


def unescape(cleaned: str) -> str:
    """Literal text of a cleaned LIKE body without wildcards."""
    out, i = [], 0
    while i < len(cleaned):
        if cleaned[i] == "\\" and i + 1 < len(cleaned):
            out.append(cleaned[i + 1])
            i += 2
        else:
            out.append(cleaned[i])
            i += 1
    return "".join(out)


def _java_literal(ch: str) -> str:
    return "\\" + ch if ch.isascii() and not ch.isalnum() else ch


def like_regex(body: str, literal=_java_literal, one: str = ".") -> str:
    """Java regex equal to ``LIKE body`` (escapes as in ``clean_escapes``);
    ``literal`` writes a character of the body and ``one`` stands for ``_``.

    ``%`` splits the body into fixed-length segments (``_`` is one
    character). Each inner segment is an atomic lazy group, so it binds to
    its earliest occurrence after the previous one and is never retried:
    the earliest end is always the best choice for a fixed-length segment,
    and the match stays linear in the text length instead of backtracking."""
    segments, current = [], []
    for kind, char in _tokens(body):
        if kind == "%":
            segments.append("".join(current))
            current = []
        else:
            current.append(one if kind == "_" else literal(char))
    segments.append("".join(current))
    regex = "(?s)^"
    last = len(segments) - 1
    for n, seg in enumerate(segments):
        if n == 0:
            regex += seg
            if last == 0:
                regex += "\\z"
        elif n == last:
            regex += f".*{seg}\\z" if seg else ""
        elif seg:
            regex += f"(?>.*?{seg})"
    return regex


def _tokens(body: str) -> list[tuple[str, str]]:
    """(kind, character) of a cleaned LIKE body: ``%``, ``_`` or ``=`` for a
    character that stands for itself."""
    out, i = [], 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            out.append(("=", body[i + 1]))
            i += 2
            continue
        out.append((body[i] if body[i] in "%_" else "=", body[i]))
        i += 1
    return out


#: The collation that insensitive terms are compared under.
COLLATION = "UNICODE_CI_AI"
# Letters that this collation holds equal to several others.
_SPELT_OUT = {"ss": "ß\u1e9e", "ae": "æÆ", "oe": "œŒ", "ij": "ĳĲ", "ff": "\ufb00", "fi": "\ufb01", "fl": "\ufb02", "ffi": "\ufb03",
              "ffl": "\ufb04", "st": "\ufb05\ufb06"}
#: Texts in which the collation compares character by character, letter case aside.
_PLAIN = r"^[\t\n\x20-\x7E]*\z"
_STATES = 60


def _units(literal: str) -> list[str]:
    """What a reader takes for one character each (a letter with its marks, a
    syllable), without what the collation ignores."""
    for spelt, letters in _SPELT_OUT.items():
        for letter in letters:
            literal = literal.replace(letter, spelt)
    ignored = lambda u: all(unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc") and c not in "\t\n\v\f\r" for c in u)
    return [u for u in regex.findall(r"\X", literal) if not ignored(u)]


def _pattern(body: str) -> tuple[list[str | None], set[int]]:
    """(units, None for ``_``; places before which anything may stand)."""
    units, free, literal = [], set(), ""
    for kind, char in [*_tokens(body), ("%", "")]:
        if kind == "=":
            literal += char
            continue
        units += _units(literal)
        literal = ""
        if kind == "_":
            units.append(None)
        else:
            free.add(len(units))
    return units, free


def _collated_like(c: Column, body: str) -> Column:
    """``c LIKE %body%`` under the collation, in one pass over the characters
    of the text. Bit k of the state says that the first k units of the body
    have been matched; a state of more bits than a number has goes on in the next one."""
    units, free = _pattern(body)
    free |= {0, len(units)}
    words = len(units) // _STATES + 1
    bits = lambda places, w: sum(1 << p - w * _STATES for p in places if w * _STATES <= p < (w + 1) * _STATES)
    loops = [bits(free, w) for w in range(words)]
    one = [bits([k for k, u in enumerate(units) if u is None], w) for w in range(words)]
    places: dict[str, list[int]] = {}
    for k, u in enumerate(units):
        if u is not None:
            places.setdefault(u, []).append(k)
    # a letter of the text that equals several of the body takes them all at once
    spelt = {}
    for name in _SPELT_OUT:
        at = [k for k in range(len(units) - len(name) + 1)
              if free.isdisjoint(range(k + 1, k + len(name))) and [u and u.lower() for u in units[k:k + len(name)]] == list(name)]
        if at:
            spelt[name] = at

    def step(state: Column, char: Column) -> Column:
        is_ = {u: char == F.lit(u) for u in [*places, *spelt]}
        out, carry = [], None
        for w in range(words):
            old, met = state[f"w{w}"], F.lit(one[w])
            for u, own in places.items():
                if bits(own, w):
                    met = met.bitwiseOR(F.when(is_[u], F.lit(bits(own, w)).cast("long")).otherwise(F.lit(0).cast("long")))
            new = F.shiftleft(old.bitwiseAND(met), 1).bitwiseOR(old.bitwiseAND(F.lit(loops[w])))
            for name, own in spelt.items():
                if bits(own, w):
                    taken = F.shiftleft(old.bitwiseAND(F.lit(bits(own, w))), len(name))
                    new = new.bitwiseOR(F.when(is_[name], taken).otherwise(F.lit(0).cast("long")))
            if carry is not None:
                new = new.bitwiseOR(carry)
            carry = F.shiftright(new, _STATES)
            out.append(new.bitwiseAND(F.lit((1 << _STATES) - 1)).cast("long").alias(f"w{w}"))
        return F.struct(*out)

    chars = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(\X)")), lambda u: F.collate(u, COLLATION)), lambda u: u != F.lit(""))
    start = F.struct(*[F.lit(1 if w == 0 else 0).cast("long").alias(f"w{w}") for w in range(words)])
    end = F.aggregate(chars, start, step)
    accepted = end[f"w{words - 1}"].bitwiseAND(F.lit(1 << len(units) - (words - 1) * _STATES)) != 0
    for piece in _pieces(body):
        accepted = F.contains(F.collate(c, COLLATION), F.lit(piece)) & accepted
    return accepted


def _pieces(body: str) -> list[str]:
    """The literal texts between the wildcards of a body."""
    said = "".join(char if kind == "=" else "\0" for kind, char in _tokens(body))
    return [piece for piece in said.split("\0") if _units(piece)]


#: Characters that the collation compares one by one, each with a weight of
#: its own letter: printable ASCII, and Latin-1 letters that are an ASCII letter with a mark.
_BASES = {c: (unicodedata.normalize("NFD", c)[0].lower()) for c in ["\t", "\n", *map(chr, range(0x20, 0x7F)), *map(chr, range(0xC0, 0x100))]
          if c.isascii() or (len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())}
# Letters without a decomposition that it holds equal to one of those.
_STRUCK = {"ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ħ": "h", "Ħ": "h"}


def _class(chars) -> str:
    """A Java character class; characters one by one are looked up in a table."""
    return "[" + "".join(f"\\x{ord(c):02X}" for c in chars) + "]"


_BASE_CLASS = _class(_BASES)


def _base(unit: str) -> str:
    """Which characters of _BASES a unit equals: those of this base. Empty if
    it equals none, having a letter of a script other than Latin; ``?`` if that isn't known."""
    plain = unicodedata.normalize("NFD", unit)
    if any(unicodedata.category(c) in ("Lo", "Ll", "Lu") and c not in "\u115f\u1160\u3164\uffa0" and "LATIN" not in unicodedata.name(c, "LATIN")
           and all(ord(x) >= 0x370 for x in unicodedata.normalize("NFKD", c)) for c in plain):
        return ""
    marked = all(0x300 <= ord(c) < 0x345 for c in plain[1:])
    return (_BASES.get(plain[0]) or _STRUCK.get(plain[0]) or "?") if marked else "?"


def _near(c: Column, size: int, gap: str) -> Column:
    """The text without what is more than ``size`` characters away from any
    character outside _BASES: there, ``size`` times ``gap`` stands."""
    # the last part goes first as far as it can and then gives back ``size``
    return F.regexp_replace(c, f"({_BASE_CLASS}{{{size}}}){_BASE_CLASS}{{{size},}}({_BASE_CLASS}{{{size}}})", "$1" + gap * size + "$2")


def _collated(c: Column, cleaned: str) -> Column:
    """``c LIKE %cleaned%`` under the collation. What takes long is asked of
    the surroundings of characters outside _BASES only: a match that is not
    there lies in a run of _BASES, where a pattern finds it. With ``%`` within
    the term this holds if all of its letters are foreign to _BASES: in a run
    of them only wildcards match, and after as many characters as the term has nothing changes."""
    whole = (lambda t: _collated_like(t, cleaned)) if has_wildcard(cleaned) else (lambda t: F.contains(F.collate(t, COLLATION), F.lit(unescape(cleaned))))
    units, free = _pattern(cleaned)
    bases = [u and _base(u) for u in units]
    inner = any(0 < place < len(units) for place in free)
    gap = next((g for g in "|~^`" if g not in bases), None)
    if not units or "?" in bases or gap is None or (inner and any(bases)):
        return whole(c)
    near = F.exists(F.array(_near(c, len(units) + 1, gap)), whole)
    if "" in bases:
        return near
    each = [_BASE_CLASS if b is None else _class(x for x, own in _BASES.items() if own == b) for b in bases]
    return c.rlike(f"{each[0]}(?<=(?:^|{_BASE_CLASS}){each[0]}){''.join(each[1:])}(?={_BASE_CLASS}|\\z)") | near


def contains_term(col, term: str, collation: str = INSENSITIVE) -> Column:
    """``col LIKE '%term%'``.

    * ``binary``: plain LIKE; Catalyst turns ``%x%`` into ``Contains`` and
      pushes it into the Parquet scan.
    * ``insensitive`` to case and accents: a literal term is searched under
      the collation COLLATION, which knows every script; ``ß`` equals ``ss``. A term
      with wildcards is compared under the same collation character by
      character, where a character is a letter with its marks or a whole
      syllable: ``_`` stands for one, and for one ``ß`` too. No literal matches
      half a character (``s`` is not in ``ß``). Texts and terms of printable
      ASCII characters, where that is lower-casing, are answered without a
      collation, with the same result.
    A NULL column never matches.
    """
    c = F.col(col) if isinstance(col, str) else col
    cleaned = clean_escapes(term)
    if collation == BINARY:
        if not has_wildcard(cleaned):
            return c.like(f"%{cleaned}%")
        return c.rlike(like_regex(f"%{cleaned}%"))
    if collation != INSENSITIVE:
        raise ValueError(f"collation is {INSENSITIVE!r} or {BINARY!r}")
    plain_term = re.match(_PLAIN.replace("\\z", "\\Z"), cleaned) is not None
    collated = _collated(c, cleaned)
    if has_wildcard(cleaned):
        quick = F.lower(c).rlike(like_regex(f"%{cleaned.lower()}%"))
    else:
        quick = F.contains(F.lower(c), F.lit(unescape(cleaned).lower()))
    return F.when(c.rlike(_PLAIN), quick).otherwise(collated) if plain_term else collated
