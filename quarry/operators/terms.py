"""A dictionary of phrases scanned over text units: every word of a unit is looked up once, and only phrases whose words are there are compared."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Words whose forms count as one: what a dictionary's word looks like, and its forms where the two differ (fixed values).
FAMILIES = [
    ("weld(?:ing|s|ed|er|ers)?", None), ("fabricat(?:e|es|ed|ing|ion|ions|or|ors)", None), ("machin(?:ing|ed|ist|ists)", None), ("repairs?", "repair(?:s|ed|ing)?"), ("installation", "install(?:s|ed|ing|ation|ations|er|ers)?"),
    ("maintenance", "(?:maintenance|maintain(?:s|ed|ing)?)"), ("painting", "paint(?:s|ed|ing|er|ers)?"), ("coatings?", "coat(?:s|ed|ing|ings)"), ("inspection", "inspect(?:s|ed|ing|ion|ions|or|ors)?"), ("testing", "test(?:s|ed|ing)?"),
    ("contract(?:ing|or|ors)", None), ("construction", "construct(?:ion|ing|ed|s)?"), ("millwright(?:ing|s)?", None), ("electrical", "electric(?:al)?"),
]
#: Words that no other form of a phrase may span, and words that join two things (fixed values).
NEVER_BETWEEN = "is are was were be the our we you your with by to in on at from that which who as into than not no engineers engineering services company team when where while if because so but it its their they this these those has have had will can may been being".split()
JOINING = ("&", "and", "or")
#: Words after which the thing acted on may follow the action.
ACTING_ON = ("of", "for", "on")


def family_of(word: str) -> str | None:
    """The forms of a word that belongs to a family."""
    return next((forms or member for member, forms in FAMILIES if re.fullmatch(member, word, re.I)), None)


def forms_of(word: str) -> str:
    """A pattern of what counts as the word: the forms of its family; else, for a word of four letters or more, itself with and without a plural ending; else the word."""
    family = family_of(word)
    if family:
        return family
    if len(word) < 4 or not re.fullmatch("[A-Za-z]+", word) or word.lower().endswith("ics"):
        return re.escape(word)
    ending = next((e for e in ("es", "s") if word.lower().endswith(e)), "")
    stem = word[: len(word) - len(ending)]
    return f"{stem if len(stem) >= 4 else word}(?:s|es)?"


#: What a unit yields: the phrase's number in the dictionary, where the match begins (from 1), how it is written, and whether it is the phrase itself.
MATCHES = "array<struct<i:int,at:int,found:string,exact:boolean>>"
_MATCH = pa.list_(pa.struct([("i", pa.int32()), ("at", pa.int32()), ("found", pa.string()), ("exact", pa.bool_())]))
_WORD = re.compile(r"[^\s/-]+")
_LETTERS = re.compile(r"[^\W_]+")
_PASSABLE = re.compile(r"(?:[^\W_]|[&’'.-])+")
_OUTER = re.compile(r"^(?:[^\w&]|_)+|(?:[^\w&]|_)+$")


class Dictionary:
    """Phrases by the stems of their longest words, and the forms of all their words; what a word of the text is a form of is found once for each word."""

    def __init__(self, phrases: list[str], most_words: int = 200_000):
        self.most_words, self.forms, self.known = most_words, {}, {}
        self.by_stem: dict[str, list[int]] = {}
        self.phrases = []
        for i, phrase in enumerate(phrases):
            words = [w for w in phrase.split() if w.lower() not in ("&", "and")]
            forms = [self.forms.setdefault(forms_of(w), len(self.forms)) for w in words]
            whole = re.compile(tx.phrase_pattern(phrase).replace(r"[\p{L}\p{N}]", r"[^\W_]"))
            longest = max((w for w in re.split(r"[\s&/-]+", phrase.lower()) if w), key=len)
            self.by_stem.setdefault(longest[:4], []).append(i)
            self.phrases.append((whole, forms, family_of(words[-1]) is not None))
        self.linking = frozenset([self.forms.setdefault("|".join(ACTING_ON), len(self.forms))])
        self.patterns = [(re.compile(form, re.I), n) for form, n in self.forms.items()]
        self.lengths = sorted({len(s) for s in self.by_stem})

    def _kinds(self, word: str) -> frozenset[int]:
        """The forms that a word without outer signs has."""
        kinds = self.known.get(word)
        if kinds is None:
            if len(self.known) >= self.most_words:
                self.known.clear()
            kinds = self.known[word] = frozenset(n for pattern, n in self.patterns if pattern.fullmatch(word))
        return kinds

    def scan(self, unit: str) -> list[dict]:
        """All matches in a unit, by phrase, then by place."""
        low = unit.lower()
        heads = {w[:n] for w in _LETTERS.findall(low) for n in self.lengths}
        near = sorted({i for head in heads for i in self.by_stem.get(head, ())})
        if not near:
            return []
        words, out = None, []
        for i in near:
            whole, forms, acts = self.phrases[i]
            found = [(m.start(), m.end(), True) for m in whole.finditer(unit)]
            if not found:
                words = words or _Words(unit, self)
                found = [(*span, False) for span in words.spans(forms, acts, self.linking)]
            out += [{"i": i, "at": a + 1, "found": unit[a:b], "exact": exact} for a, b, exact in found]
        return out


class _Words:
    """The words of one unit with their places, and the spans of a phrase's words in other forms."""

    def __init__(self, unit: str, dictionary: Dictionary):
        cut = [(m.start(), m.group()) for m in _WORD.finditer(unit)]
        bare = [_OUTER.sub("", w) for _, w in cut]
        self.low = [w.lower() for _, w in cut]
        self.kinds = [dictionary._kinds(b.lower()) for b in bare]
        self.begins = [at + w.find(b) for (at, w), b in zip(cut, bare, strict=True)]
        self.ends = [at + len(b) for at, b in zip(self.begins, bare, strict=True)]
        self.open_left = [w.find(b) > 0 for (_, w), b in zip(cut, bare, strict=True)]
        self.open_right = [w.find(b) + len(b) < len(w) for (_, w), b in zip(cut, bare, strict=True)]
        self.passable = [bool(_PASSABLE.fullmatch(w)) and w not in NEVER_BETWEEN for w in self.low]

    def _first(self, form: int) -> list[tuple[int, int]]:
        return [(i, i) for i, kinds in enumerate(self.kinds) if form in kinds]

    def _on(self, spans: list[tuple[int, int]], form: int, between: int, may_join: bool) -> list[tuple[int, int]]:
        """Spans carried to the next words of a form. Signs inside a span, and words that end a thought, break it; a joining word right before counts as a break unless may_join."""
        out = []
        for a, b in spans:
            if self.open_right[b]:
                continue
            for i in range(b + 1, min(b + 2 + between, len(self.low))):
                joined = i > b + 1 and self.low[i - 1] in JOINING
                if form in self.kinds[i] and not self.open_left[i] and (may_join or not joined):
                    out.append((a, i))
                if not self.passable[i]:
                    break
        return out

    def spans(self, forms: list[int], acts: bool, linking: frozenset[int]) -> list[tuple[int, int]]:
        """Begin and end of matches: the words in order, else the action, 'of' and the thing, else the action and the thing. Matches don't overlap; from one place the shortest counts."""
        n = len(forms)

        def thing(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
            spans = self._on(spans, forms[0], 3, n != 2)
            for form in forms[1:-1]:
                spans = self._on(spans, form, 0, True)
            return spans

        met = self._first(forms[0])
        for k, form in enumerate(forms[1:], 1):
            met = self._on(met, form, 2, k < n - 1)
        if not met and n > 1:
            action = self._first(forms[-1])
            met = thing([s for form in linking for s in self._on(action, form, 0, True)]) or (thing(action) if acts else [])
        out, free = [], 0
        for a, b in sorted(met):
            if a >= free:
                out.append((self.begins[a], self.ends[b]))
                free = b + 1
        return out


def dictionary_matches(unit: Column, phrases: list[str]) -> Column:
    """All matches of a dictionary's phrases in a unit (see MATCHES). The dictionary goes with the function to every task; a null unit has no match."""
    held: list[Dictionary] = []

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(Dictionary(phrases))
        for units in batches:
            yield pa.array([held[0].scan(u) if u else [] for u in units.to_pylist()], _MATCH)

    return F.arrow_udf(scan, MATCHES)(unit)
