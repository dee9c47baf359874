"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a regular expression. The whole tokens (runs of letters and digits) that any URL it fits
must have are read off the expression itself. Of those the one that the fewest URLs have, counted over all URLs, is the rule's entry in the
index. A URL's tokens fetch candidate rules, and only their regular expressions run. Rules without
a token are candidates for every URL.

Small rule lists become literals of one projection, without a shuffle; longer ones are joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A regular expression over host + path. ``name`` marks a prefix rule, of which the longest wins; others block."""

    pattern: str
    verdict: str = "block"
    name: str | None = None

    @property
    def tokens(self) -> tuple[str, ...]:
        return whole_tokens(self.pattern)


def _alnum(c: int) -> bool:
    return c < 128 and chr(c).isalnum()


def _class_has_alnum(items) -> bool:
    """Whether a character class can take a letter or digit (if in doubt, yes)."""
    for op, arg in items:
        if op is sre.LITERAL and not _alnum(arg):
            continue
        if op is sre.RANGE and not any(_alnum(c) for c in range(arg[0], min(arg[1], 127) + 1)):
            continue
        if op is sre.NEGATE:
            # [^...] is free of letters and digits if all of them are listed.
            listed = {c for o, a in items if o is sre.RANGE for c in range(a[0], min(a[1], 127) + 1)} | {a for o, a in items if o is sre.LITERAL}
            return not all(c in listed for c in range(128) if _alnum(c))
        return True
    return False


def _is_border(op, arg) -> bool:
    """Whether what an item takes is never a letter or digit, and it takes a character or an end of the text."""
    if op is sre.LITERAL:
        return not _alnum(arg)
    if op is sre.AT:
        return arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING)
    if op is sre.IN:
        return not _class_has_alnum(arg)
    if op is sre.SUBPATTERN:
        return len(arg[-1]) == 1 and _is_border(*arg[-1][0])
    if op is sre.BRANCH:
        return all(len(b) == 1 and _is_border(*b[0]) for b in arg[1])
    return False


def _ends_in_border(items) -> bool:
    """Whether the text before what follows ``items`` surely ends in a border; an optional last item may be skipped."""
    items = list(items)
    if not items:
        return False
    op, arg = items[-1]
    if op is sre.MAX_REPEAT:
        return _ends_in_border(arg[2]) and (arg[0] > 0 or _ends_in_border(items[:-1]))
    if op is sre.SUBPATTERN and len(arg[-1]) > 1:
        return _ends_in_border(arg[-1])
    return _is_border(op, arg)


def whole_tokens(pattern: str) -> tuple[str, ...]:
    """The runs of letters and digits that every text the pattern fits has as whole tokens: literals between borders.

    What is optional, repeated, alternative or next to something that could take a letter or digit gives none.
    """
    out: list[str] = []

    def walk(items) -> None:
        items = list(items)
        flat = []
        for op, arg in items:  # a plain group is what it holds
            if op is sre.SUBPATTERN and not arg[1] and not arg[2] and len(arg[-1]) and not _is_border(op, arg):
                flat.extend(arg[-1])
            else:
                flat.append((op, arg))
        k = 0
        while k < len(flat):
            if flat[k][0] is sre.LITERAL and _alnum(flat[k][1]):
                end = k
                while end < len(flat) and flat[end][0] is sre.LITERAL and _alnum(flat[end][1]):
                    end += 1
                if _ends_in_border(flat[:k]) and end < len(flat) and _is_border(*flat[end]):
                    out.append("".join(chr(a) for _, a in flat[k:end]))
                k = end
            else:
                k += 1

    walk(_parser.parse(pattern))
    return tuple(dict.fromkeys(out))


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; a host ends at the path's slash or the URL's end."""
    inner = re.escape(host) + (re.escape(path) if path else "(?:/|$)")
    return Rule(rf"^(?:[^/]*\.)?{inner}", verdict, host + path)


def words_rule(*words: str) -> Rule:
    """Blocks hosts with these words next to each other, joined by a mark."""
    return Rule(r"^(?:[^/]*[^A-Za-z0-9/])?" + "[-_.]".join(map(re.escape, words)) + r"(?:[^A-Za-z0-9]|$)")


def path_rule(*parts: str) -> Rule:
    """Blocks paths that hold these tokens one after the other, joined by a mark, between marks."""
    return Rule(r"^[^/]*/(?:[^?]*[^A-Za-z0-9])?" + "[-_./]".join(map(re.escape, parts)) + r"(?:[^A-Za-z0-9]|$)" if len(parts) > 1 else rf"/{re.escape(parts[0])}(?:[^A-Za-z0-9]|$)")


#: What is blocked where no prefix rule fits: words of hosts, and words that follow each other there or in paths.
HOST_WORDS = ("spam", "casino", "adult", "porn", "xxx", "pills", "viagra", "bets", "betting", "ads", "malware", "phishing")
HOST_PAIRS = (("free", "money"), ("online", "poker"), ("cheap", "meds"), ("click", "tracker"), ("sex", "cams"), ("fake", "id"), ("essay", "mill"), ("link", "farm"))
PATH_WORDS = ("doorway", "popunder", "adserver")
PATH_RUNS = (("wp", "login", "php"), ("xmlrpc", "php"), ("cgi", "bin", "ads"), ("affiliate", "click"), ("ad", "redirect"), ("phpmyadmin", "index", "php"))
DEFAULT_RULES = (*(words_rule(w) for w in HOST_WORDS), *(words_rule(*w) for w in HOST_PAIRS), *(path_rule(w) for w in PATH_WORDS), *(path_rule(*w) for w in PATH_RUNS))


def host_path(url: Column) -> tuple[Column, Column]:
    """A URL's host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rarest(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[int, str]:
    """Each rule's index token: the one that the fewest rows of ``urls`` (tokens) have. Rules without tokens have none."""
    tokens = [r.tokens for r in rules]
    words = sorted({t for some in tokens for t in some})
    if not words:
        return {}
    # One count a rule token comes back, however many URLs there are.
    counts = {r["t"]: r["n"] for r in urls.select(F.explode(F.array_intersect("tokens", F.lit(words))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    return {k: min(some, key=lambda t: (counts.get(t, 0), t)) for k, some in enumerate(tokens) if some}


def judge(pages: DataFrame, rules: tuple[Rule, ...], inline: int = 256, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    The longest prefix rule that fits decides and is named in ``rule``; else any other rule that fits
    blocks; else the URL is allowed, as are null URLs and those without ``://``, whose host and path are
    empty. Repeated rows and null ids are judged like any others; an empty table gives no rows.
    """
    host, path = host_path(F.coalesce(F.col(url_col), F.lit("")))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("whole", F.concat("host", "path"))
    urls = urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all("whole", F.lit(_TOKEN), F.lit(0))))
    index = rarest(urls, rules)
    always = [k for k in range(len(rules)) if k not in index]
    by_token: dict[str, list[int]] = {}
    for k, t in index.items():
        by_token.setdefault(t, []).append(k)
    if len(rules) <= inline:
        patterns = F.array(*[F.lit(r.pattern) for r in rules])
        found = F.lit(always).cast("array<int>") if always else F.array().cast("array<int>")
        if by_token:
            table = F.create_map(*[x for t, k in sorted(by_token.items()) for x in (F.lit(t), F.array(*[F.lit(i) for i in k]))])
            known = F.lit(sorted(by_token))
            found = F.concat(found, F.flatten(F.transform(F.array_intersect("tokens", known), lambda t: table[t])))
        fits = F.filter(found, lambda k: F.regexp_like(F.col("whole"), F.get(patterns, k))) if rules else found
        size = F.array(*[F.lit(len(r.name) if r.name is not None else -1) for r in rules] or [F.lit(-1)])
        best = F.array_max(F.transform(fits, lambda k: F.struct(F.get(size, k).alias("size"), k.alias("k"))))
        judged = urls.withColumn("best", best)
    else:
        spark = pages.sparkSession
        listed = spark.createDataFrame([(t, k, rules[k].pattern, len(rules[k].name) if rules[k].name is not None else -1) for t, ks in by_token.items() for k in ks], "t string, k int, pattern string, size int")
        distinct = urls.select("host", "path", "whole", "tokens").distinct()
        hits = distinct.select("host", "path", "whole", F.explode("tokens").alias("t")).join(listed, "t").where(F.regexp_like("whole", F.col("pattern"))).select("host", "path", "size", "k")
        for k in always:
            hits = hits.unionAll(distinct.where(F.regexp_like("whole", F.lit(rules[k].pattern))).select("host", "path", F.lit(len(rules[k].name) if rules[k].name is not None else -1).alias("size"), F.lit(k).alias("k")))
        judged = urls.join(hits.groupBy("host", "path").agg(F.max(F.struct("size", "k")).alias("best")), ["host", "path"], "left")
        named = spark.createDataFrame([(k, r.name, r.verdict) for k, r in enumerate(rules)], "k int, rule string, verdict string")
        judged = judged.withColumn("k", F.col("best.k")).join(named, "k", "left")
        return judged.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    names, verdicts = (F.array(*[F.lit(getattr(r, f)).cast("string") for r in rules] or [F.lit(None).cast("string")]) for f in ("name", "verdict"))
    rule = F.get(names, F.col("best.k"))
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(F.get(verdicts, F.col("best.k")), F.lit("allow")).alias("verdict"))
