"""URL rules as one bit-parallel automaton (Shift-And with gaps over several 64-bit words).

A rule is a glob over the canonical URL `.host SEP path`: literals, `?` for one symbol and `*` for
any run. All rules are packed side by side into one mask; one step per symbol advances every
pattern of every URL of the batch at once. SEP is a symbol of its own that no URL holds, so a host
pattern can never match inside a path.

Defined cases: a null URL or one without `://` has an empty host and path and fits no host rule;
copies are judged alike; an empty table gives an empty result; other columns pass through, but host,
path, rule and verdict are replaced.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SEP, ANY, RUN = 256, -1, -2
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_glob(rule: str) -> list[int]:
    """`host/path` as a pattern: the host or any subdomain, then any path that starts so."""
    name, _, rest = rule.partition("/")
    return [RUN, *("." + name.lower()).encode(), SEP, *("/" + rest).encode(), RUN]


def glob(text: str) -> list[int]:
    """A free glob over host and path; `|` stands for the border between both."""
    return [{"*": RUN, "?": ANY, "|": SEP}.get(c, None) if c in "*?|" else b
            for c in text for b in (c.encode() if c not in "*?|" else b"\0")]


class Automaton:
    """Masks of all patterns; `match` gives a boolean per text and pattern."""

    def __init__(self, patterns: list[list[int]]):
        self.lengths = [sum(s != RUN for s in p) for p in patterns]
        total = sum(n + 1 for n in self.lengths)
        self.words = max(1, -(-total // 64))
        step = np.zeros((257, total), bool)  # symbol moves into state
        loop, start, accept, at = np.zeros(total, bool), np.zeros(total, bool), [], 0
        for p in patterns:
            start[at] = True
            state = at
            for s in p:
                if s == RUN:
                    loop[state] = True
                else:
                    state += 1
                    step[slice(None) if s == ANY else s, state] = True
                    if s == ANY:
                        step[SEP, state] = False
            accept.append(state)
            at = state + 1
        self.step, self.loop, self.start = self._pack(step), self._pack(loop), self._pack(start)
        self.accept = np.array(accept, np.int64)

    def _pack(self, bits):
        padded = np.zeros((*bits.shape[:-1], self.words * 64), bool)
        padded[..., :bits.shape[-1]] = bits
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    def match(self, symbols, offsets):
        """symbols: uint16 codes of all texts in a row; offsets: bounds of each text."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        first, alive = offsets[:-1][order], size[order]
        state = np.repeat(self.start[None, :], len(size), axis=0)
        for t in range(int(alive[0]) if len(alive) else 0):
            n = int(np.searchsorted(-alive, -t, "left"))  # texts longer than t come first
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.step[symbols[first[:n] + t]]
            state[:n] = moved | (now & self.loop)
        out = np.zeros((len(size), len(self.accept)), bool)
        bit = (state[:, self.accept >> 6] >> (self.accept & 63).astype(np.uint64)) & np.uint64(1)
        out[order] = bit.astype(bool)
        return out


def codes(hosts, paths):
    """Symbol codes of `.host SEP path` of every row."""
    parts = [(b"." + h.encode(), p.encode()) for h, p in zip(hosts, paths)]
    size = np.array([len(h) + 1 + len(p) for h, p in parts], np.int64)
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.frombuffer(b"".join(h + b"\0" + p for h, p in parts), np.uint8).astype(np.int16)
    out[offs[:-1] + np.array([len(h) for h, _ in parts], np.int64)] = SEP
    return out, offs


def judge(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow",
          globs: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Add host, path, rule and verdict. `rules` are (verdict, `host/path`), `globs` (verdict, glob).

    The longest fitting host rule decides, the earlier of two as long; then the first fitting glob;
    then `default`, with a null rule. `rule` names the host rule or glob.
    """
    texts = [r for _, r in rules] + [g for _, g in globs]
    verdicts = [v for v, _ in rules] + [v for v, _ in globs]
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i)) + list(range(len(rules), len(texts)))
    patterns = [rule_glob(r) for _, r in rules] + [glob(g) for _, g in globs]

    def fit(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        if not texts or not len(hosts):
            return pd.Series([-1] * len(hosts), dtype="int32")
        hit = Automaton([patterns[i] for i in rank]).match(*codes(hosts, paths))
        best = np.where(hit.any(axis=1), np.array(rank)[hit.argmax(axis=1)], -1)
        return pd.Series(best.astype(np.int32))

    choose = F.pandas_udf(fit, "int")
    known = F.array(*[F.lit(t) for t in texts]) if texts else F.array(F.lit(None).cast("string"))
    said = F.array(*[F.lit(v) for v in verdicts]) if verdicts else F.array(F.lit(default))
    # Columns of these names are replaced.
    others = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    out = urls.select(F.struct(*others).alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    out = out.withColumn("fit", choose("host", "path"))
    return out.select("row.*", "host", "path", F.when(F.col("fit") >= 0, F.get(known, F.col("fit"))).alias("rule"),
                      F.when(F.col("fit") >= 0, F.get(said, F.col("fit"))).otherwise(default).alias("verdict"))
