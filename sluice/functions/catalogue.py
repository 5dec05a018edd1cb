"""A catalogue of message templates: each message meets the few templates that share a word with it, and the one with most captures wins.

The catalogue is an index by words, so neither the plan nor the work of a message grows with the number of templates.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sluice.functions.grammar import pattern, printf

#: (rule, printf template, names of its conversions).
Template = tuple[str, str, list[str]]
MATCH = "template struct<rule:string,place:int,fields:map<string,string>>"


@dataclass
class _Entry:
    place: int
    rule: str
    names: list[str]
    found: re.Pattern


def _words(template: str) -> list[str]:
    """Words of a template that every message of it has between spaces or at its ends: those that touch no conversion."""
    marked = re.sub(r"%%", "\x01", template)
    marked = re.sub(r"%[-+ 0#]*\d*(?:\.\d+)?(?:l|ll|h|z)?[diuxfgcs]", "\x02", marked)
    return [w.replace("\x01", "%") for w in marked.split(" ") if w and "\x02" not in w]


class Catalogue:
    """Templates, indexed by the word of each that fewest templates share. Templates without a whole word are tried for all messages."""

    def __init__(self, templates: list[Template]) -> None:
        self.templates = templates
        shared = Counter(w for _, t, _ in templates for w in set(_words(t)))
        self.by_word: dict[str, list[_Entry]] = defaultdict(list)
        self.rest: list[_Entry] = []
        for place, (rule, template, names) in enumerate(templates):
            grammar = printf(template, names)
            ours = [n for n, _, _ in grammar if n]
            entry = _Entry(place, rule, ours, re.compile(pattern(grammar)[:-1] + r"\s*\Z", re.S))
            words = _words(template)
            (self.by_word[min(words, key=lambda w: (shared[w], w))] if words else self.rest).append(entry)

    def candidates(self, message: str) -> list[_Entry]:
        """The templates that may fit, most captures first, then the earlier one."""
        found = [e for w in set(message.split()) for e in self.by_word.get(w, ())] + self.rest
        return sorted(found, key=lambda e: (-len(e.names), e.place))

    def match(self, message: str | None) -> tuple[str, int, dict[str, str]] | None:
        """(rule, place, fields) of the best template; of equal ones the earlier. Of a name that is there twice the last value counts."""
        for entry in self.candidates(message or "") if message is not None else ():
            if found := entry.found.match(message):
                return entry.rule, entry.place, dict(zip(entry.names, found.groups(), strict=True))
        return None

    def of_samples(self, samples: list[str]) -> Catalogue:
        """The catalogue of the templates that samples of a log belong to, in this one's order; a sample without one is an error."""
        places = {s: self.match(s) for s in samples}
        if lost := [s for s, m in places.items() if m is None]:
            raise ValueError(f"no template fits: {lost[0]}")
        return Catalogue([self.templates[p] for p in sorted({m[1] for m in places.values() if m})])


def matched(df: DataFrame, message: str, catalogue: Catalogue) -> DataFrame:
    """df with column template, a struct (rule, place, fields), null where none fits. Equal messages of a batch are matched once."""
    sent = df.sparkSession.sparkContext.broadcast(catalogue)
    kind = pa.struct([("rule", pa.string()), ("place", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(message).dictionary_encode()
            made = [sent.value.match(m) for m in coded.dictionary.to_pylist()]
            rows = pa.array([m and {"rule": m[0], "place": m[1], "fields": list(m[2].items())} for m in made], kind)
            yield batch.append_column("template", rows.take(coded.indices))

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(MATCH).fields]))
