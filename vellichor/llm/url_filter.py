"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed, one bit per pattern symbol, into the words of a multiword Shift-And mask. One pass over
the symbols of a canonical URL simulates every pattern at once; a batch of URLs is stepped together with numpy.

Canonical URL: "." + host + boundary + path. A rule (host, path) becomes "*." host boundary path "*": it fits its
host and all subdomains where the path starts with the rule's. The boundary is a symbol outside the byte range, so
no byte of a URL can stand for it. In rule hosts and paths "*" is any run of bytes and "?" any one byte.

Defined results: null url or one without "://": empty host and path, no rule, the default verdict. Rules of equal
length: the first given wins. Empty rule list: the default verdict everywhere. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDARY = 256  # symbol between host and path
MAX_SYMBOLS = 257
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


class Automaton:
    """Shift-And over several 64-bit words; bit i is on when the symbols up to pattern position i have matched."""

    def __init__(self, rules: Sequence[Rule]):
        symbols: list[int | None] = []  # None: any byte
        loops: list[int] = []  # positions that stay on over any byte
        first, self.last = [], []
        for rule in rules:
            first.append(len(symbols))
            for part in (b"." + rule.host.encode(), None, rule.path.encode()):
                if part is None:
                    symbols.append(BOUNDARY)
                    continue
                for byte in part:
                    if byte == ord("*"):
                        if len(symbols) > first[-1] and len(symbols) - 1 not in loops:
                            loops.append(len(symbols) - 1)
                    else:
                        symbols.append(None if byte == ord("?") else byte)
            self.last.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.table = np.zeros((MAX_SYMBOLS, self.words), np.uint64)
        for i, symbol in enumerate(symbols):
            at = slice(0, 256) if symbol is None else symbol
            self.table[at, i // 64] |= np.uint64(1 << (i % 64))
        self.start, self.loop = self._mask(first), self._mask(loops)

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for i in bits:
            mask[i // 64] |= np.uint64(1 << (i % 64))
        return mask

    def matches(self, urls: Sequence[np.ndarray]) -> np.ndarray:
        """urls: arrays of symbols. For each url and rule: did the rule's last position ever switch on?"""
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lengths = np.array([len(urls[i]) for i in order])
        flat = np.concatenate([urls[i] for i in order]) if len(urls) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(urls) else lengths
        state = np.zeros((len(urls), self.words), np.uint64)
        seen = np.zeros_like(state)
        one, top = np.uint64(1), np.uint64(63)
        active = len(urls)
        for step in range(int(lengths[0]) if len(urls) else 0):
            while active and lengths[active - 1] <= step:
                active -= 1
            now = state[:active]
            symbol = flat[begin[:active] + step]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top  # carry between words
            stay = np.where((symbol < BOUNDARY)[:, None], now & self.loop, np.uint64(0))
            state[:active] = ((moved | self.start) & self.table[symbol]) | stay
            seen[:active] |= state[:active]
        hit = np.zeros((len(urls), len(self.last)), bool)
        for k, i in enumerate(self.last):
            hit[order, k] = (seen[:, i // 64] >> np.uint64(i % 64)) & one != 0
        return hit


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages."""
    automaton, ranked = Automaton(rules), sorted(range(len(rules)), key=lambda k: -len(rules[k].name.encode()))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            urls = [
                np.concatenate([np.frombuffer(b"." + h.encode("utf-8", "surrogatepass"), np.uint8), [BOUNDARY], np.frombuffer(p.encode("utf-8", "surrogatepass"), np.uint8)]).astype(np.int64)
                for h, p in zip(batch["host"], batch["path"])
            ]
            rule = np.full(len(batch), -1)
            if rules:
                hit = automaton.matches(urls)
                for k in reversed(ranked):  # the longest is set last
                    rule[hit[:, k]] = k
            batch["rule"] = [rules[k].name if k >= 0 else None for k in rule]
            batch["verdict"] = [rules[k].verdict if k >= 0 else default for k in rule]
            yield batch

    url = F.col(url_col)
    plain = pages.select(F.col(id_col), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    return plain.mapInPandas(judge, f"`{id_col}` {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string")
