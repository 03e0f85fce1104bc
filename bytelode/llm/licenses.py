"""License scans by conditional compression.

Texts with words of licenses are candidates.  Every template is compared with such a text by wording, whatever its line
breaks: the template's words must stand at some place in the text in order but for a small share, and its telling words
(names, and in short forms and notices numbers) must all be there, without another one in their place.  The place,
lower-cased, is compressed by zstandard alone and with the template as a raw dictionary.  Of places that overlap, the one for which the
size goes down by most stays, less a word's usual size for each difference in wording: a whole text wins over its opening,
and of two texts that share much the one whose wording is there.  Each place that stays is a row.  ``SPDX-License-Identifier``
lines are a template with a slot: the identifiers after it are the license, whatever they are.

Defined cases: null and empty texts have no places; a text that confirms no template is not reported; an opening that several
licenses share is reported with all of their names; of equal places the one with fewer differences wins, then the name, then the
first; texts of any length are searched as a whole; repeated rows are reported each; an empty table gives an empty result; columns
besides ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from bytelode.llm.common import map_arrow
from bytelode.llm.license_texts import FULL, NOTICES, SHORT

#: (license, template).
TEMPLATES: list[tuple[str, str]] = [*SHORT, *NOTICES, *FULL]
#: In these numbers are items or years, which come and go.
LOOSE = frozenset(range(len(SHORT) + len(NOTICES), len(TEMPLATES)))
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][\w.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][\w.+-]*\)*)*)", re.I | re.A)
#: Bytes that a word which differs takes, about.
WORD_SIZE = 6
#: Words that tell one license from another: each must match exactly.
TELLING = frozenset("mit apache gnu lesser affero mozilla boost bsd isc cc cc0 by-sa by-nc by-nd by-nc-sa by-nc-nd clause 2-clause 3-clause general mpl gpl lgpl agpl creative commons".split())
HINT = re.compile(r"licen[cs]|copyright|spdx|permission|redistribut|warrant|sublicens|public[\W_]+domain|creative[\W_]+commons|\bcc[\W_]?(?:by|0)|\bgnu\b|source[\W_]+code[\W_]+form", re.I)
WORDS = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def words(text: str) -> list[str]:
    return [w.lower().rstrip(".") for w in WORDS.findall(text)]


def telling(word: str, loose: bool) -> bool:
    return word in TELLING or not loose and any(c.isdigit() for c in word)


@lru_cache(maxsize=1)
def dictionaries() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    return [(name, words(t), zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, t in TEMPLATES]


@lru_cache(maxsize=1)
def vocabulary() -> tuple[dict[str, int], np.ndarray]:
    """Places of the templates' words, and [template, place]: whether it has the word; the last place is for all other words."""
    place = {w: i for i, w in enumerate(sorted({w for _, t, _ in dictionaries() for w in t}))}
    has = np.zeros((len(TEMPLATES), len(place) + 1), bool)
    for i, (_, t, _) in enumerate(dictionaries()):
        has[i, [place[w] for w in t]] = True
    return place, has


#: Costs are differences times UNIT, less the place's first word, so that of equal costs the shortest place wins.
UNIT, NEVER = 1 << 32, 1 << 52


def aligned(template: list[str], found: list[str], most: int, loose: bool) -> list[tuple[int, int, int]]:
    """(differences, first, stop) of the places in ``found``, one for each word at which one ends, that differ from the
    template in at most ``most`` words left out or added; telling words are never left out or added."""
    out = np.array([NEVER if telling(w, loose) else UNIT for w in template])
    total = np.concatenate([[0], np.cumsum(out)])
    same = {w: np.array([t == w for t in template]) for w in set(template) & set(found)}
    cost, places = total.copy(), []
    for j, w in enumerate(found):
        step = cost + (NEVER if telling(w, loose) else UNIT)
        if w in same:
            step[1:] = np.where(same[w], np.minimum(step[1:], cost[:-1]), step[1:])
        step[0] = -(j + 1)
        cost = np.minimum.accumulate(step - total) + total
        differences = -(-int(cost[-1]) // UNIT)
        if differences <= most and (first := differences * UNIT - int(cost[-1])) <= j:
            places.append((differences, first, j + 1))
    return places


def confirmed(found: list[str], slack: float) -> Iterator[tuple[int, int, int, int]]:
    """(template, differences, first, stop) of all places for the templates.  Looked for only where a stretch, as long as
    a place can be, has as many of the template's words as a place must have."""
    place, has = vocabulary()
    spots = np.array([place.get(w, len(place)) for w in found], np.int64)
    for i, (_, template, _) in enumerate(dictionaries()):
        most = int(slack * len(template))
        longest, least = len(template) + most, len(template) - most
        held = np.concatenate([[0], np.cumsum(has[i, spots])])
        ends = np.minimum(np.arange(len(found)) + longest, len(found))
        starts = np.flatnonzero(held[ends] - held[:-1] >= least)
        if len(starts):
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > longest) + 1):
                low, high = int(part[0]), int(ends[part[-1]])
                for differences, first, stop in aligned(template, found[low:high], most, i in LOOSE):
                    yield i, differences, low + first, low + stop


def gain(text: str, template: int) -> tuple[int, int]:
    """Bytes that the template as a dictionary saves of the text compressed, and bytes without it."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    alone = len(zstandard.ZstdCompressor(level=3).compress(raw))
    return alone - len(dictionaries()[template][2].compress(raw)), alone


def apart(ranked: list[tuple], start: int, end: int) -> list[tuple]:
    """Those of the rows, in their order, that overlap none before; their range is at these places."""
    taken: list[tuple[int, int]] = []
    out = []
    for row in ranked:
        span = row[start], row[end]
        at = bisect.bisect(taken, span[:1])
        if (not at or taken[at - 1][1] <= span[0]) and (at == len(taken) or span[1] <= taken[at][0]):
            taken.insert(at, span)
            out.append(row)
    return out


def scan_text(text: str | None, slack: float = 0.25) -> list[tuple]:
    """(start, end, license, reduction, differences) of the places, in code points; none overlaps another."""
    if not text or not HINT.search(text):
        return []
    spans = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    # Of one template the places with the fewest differences; then, of all, those that compression ranks first.
    places: dict[int, list[tuple[int, int, int]]] = {}
    for i, d, first, stop in confirmed([text[a:b].lower().rstrip(".") for a, b in spans], slack):
        places.setdefault(i, []).append((d, first, stop))
    ranked = []  # (bytes that differ less bytes saved, differences, license, start, end, reduction)
    for i, own in places.items():
        for d, first, stop in apart(sorted(own), 1, 2):
            start, end = spans[first][0], spans[stop - 1][1]
            saved, alone = gain(text[start:end], i)
            # A mark that ends the sentence belongs to the place.
            ranked.append((WORD_SIZE * d - saved, d, dictionaries()[i][0], start, end + (text[end : end + 1] in (".", ":", ";")), saved / alone))
    for m in SPDX.finditer(text):
        # The line's mark is the template, and nothing else explains it as well; it saves what is not identifiers.
        name = m[1].rstrip(".-")
        alone, rest = (len(zstandard.ZstdCompressor(level=3).compress(x.lower().encode())) for x in (m[0], name))
        ranked.append((-len(m[0]), 0, name, m.start(), m.start(1) + len(name), (alone - rest) / alone))
    return sorted((start, end, name, reduction, d) for _, d, name, start, end, reduction in apart(sorted(ranked), 3, 4))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop, license, reduction (share of the compressed size), differences (words): a row for each place found."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, *r) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for r in scan_text(text)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "start", "stop", "license", "reduction", "differences"])

    return map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, start long, stop long, license string, reduction double, differences long")
