"""URL filters: host and path rules by longest match, and pattern rules found through their rarest literal token.

DataFrame operations only. Every match of a pattern rule holds certain literal tokens, which are read off the pattern; the corpus says
how many URLs hold each, and the rule is filed under its rarest one. A URL's own tokens then fetch its candidate rules by an equality
join, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS

#: Parts that the rows of one URL are dealt to when matches go back to them.
SALTS = 16
#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


BORDER, UNSURE = "border", "unsure"
_SIGNS = frozenset("!\"#%&',-/:;<=>@_`~ ")
_CLASS = re.compile(r"\[((?:\\[^A-Za-z0-9]|[-!\"#$%&'()*+,./:;<=>?@_`{|}~ ])+)\]")
_COUNT = re.compile(r"(\?|\*|\+|\{(\d+)(?:,\d*)?\})[?+]?")


class _Reader:
    """Reads a pattern into a list of items, one for each of its parts in a row: a letter or digit, BORDER (one or more signs that are
    neither, or an end of the text), or UNSURE (anything else). What it doesn't know for certain raises ValueError."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern.removeprefix("(?i)"), 0

    def options(self) -> list[list[str]]:
        out: list[list[str]] = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                self.at += 1
                out.append([])
            else:
                self.part(out[-1])
        return out

    def part(self, items: list[str]) -> None:
        c, inner = self.text[self.at], None
        if c == "(":
            self.at += 1
            if self.text.startswith("?", self.at):
                if not self.text.startswith("?:", self.at):
                    raise ValueError("a group with a flag, a name or a look around it")
                self.at += 2
            inner = self.options()
            if not self.text.startswith(")", self.at):
                raise ValueError("an open group")
            self.at += 1
            one = [UNSURE]
        elif c == "[":
            known = _CLASS.match(self.text, self.at)
            if known and "&&" not in known[1] and not re.search(r"(?<=.)(?<!\\)-(?=.)", known[1]):
                self.at, one = known.end(), [BORDER]
            else:
                self.skip_class()
                one = [UNSURE]
        elif c == "\\":
            d = self.text[self.at + 1 : self.at + 2]
            if not d or not d.isascii() or (d.isalnum() and d not in "dDwWsSbB"):
                raise ValueError(f"an escape: {d}")
            self.at += 2
            one = [UNSURE if d.isalnum() else BORDER]
        elif c in "^$":
            self.at, one = self.at + 1, [BORDER]
        else:
            if c in ")]{}*+?":
                raise ValueError(f"a bare {c}")
            self.at += 1
            one = [c.lower() if c.isascii() and c.isalnum() else BORDER if c in _SIGNS else UNSURE]
        count = _COUNT.match(self.text, self.at)
        if not count:
            if inner and len(inner) > 1:  # what all options begin with
                same = [k for k, x in enumerate(zip(*inner)) if len(set(x)) > 1]
                one = inner[0][: same[0] if same else min(map(len, inner))] + [UNSURE]
            items += inner[0] if inner and len(inner) == 1 else one
            return
        self.at = count.end()
        if self.text[self.at : self.at + 1] in {"?", "*", "+", "{"} - {""}:
            raise ValueError("a count of a count")
        before = items[-1] if items else UNSURE
        if one == [BORDER] and c not in "^$" and (count[1] == "+" or int(count[2] or 0) >= 1):
            items.append(BORDER)
        elif inner and len(inner) == 1 and inner[0][-1:] == [BORDER] and before == BORDER:
            items.append(BORDER)  # however often it stands there, a sign stands before what follows
        else:
            items.append(UNSURE)

    def skip_class(self) -> None:
        at = self.at + 1 + self.text.startswith("[^", self.at)
        at += self.text.startswith("]", at)
        while at < len(self.text) and self.text[at] != "]":
            if self.text[at] == "[" or self.text.startswith("&&", at):
                raise ValueError("a class in a class")
            at += 2 if self.text[at] == "\\" else 1
        self.at = at + 1


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The tokens [a-z0-9]+ (lower case) that every string matching the pattern holds as whole tokens: runs of letters and digits with a
    sign, or an end of the text, on either side. What may be left out, repeated or chosen gives none, nor does a pattern with anything
    that the reader doesn't know: the list may be short but never wrong."""
    reader = _Reader(pattern)
    try:
        options = reader.options()
        if reader.at < len(reader.text):
            raise ValueError("a bare )")
    except ValueError:
        return ()
    if len(options) > 1:
        return ()
    found, run, before = [], "", UNSURE
    for k, item in enumerate([*options[0], UNSURE]):
        if len(item) == 1:
            before = before if run else options[0][k - 1] if k else UNSURE
            run += item
        else:
            if run and before == item == BORDER:
                found.append(run)
            run = ""
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class PatternRule:
    """A regular expression that blocks what it matches. tokens: those it is filed under; by default all that the pattern implies. Tokens
    that it doesn't imply are refused, since URLs without them would be lost."""

    rule_id: int
    pattern: str
    tokens: tuple[str, ...] = ()

    def __post_init__(self):
        implied = literal_tokens(self.pattern)
        if not implied or not set(self.tokens) <= set(implied):
            raise ValueError(f"rule {self.rule_id}: a match need not hold {self.tokens or 'any literal token'}")
        object.__setattr__(self, "tokens", self.tokens or implied)


#: Words that block a host when a label, or a part of it between hyphens, is that word. Fixed values, by kind.
HOST_WORDS = {
    "gambling": "bet bets betting bingo casino casinos gambling jackpot lottery poker roulette slots sportsbook wager",
    "adult": "adult cams escort escorts hentai milf nude nudes porn porno sex sexy xxx",
    "pharmacy": "cialis pharmacy pills viagra xanax",
    "advertising": "ad ads adserver adservice advert adverts banners clicktrack doubleclick popads tracker trackers",
    "fraud": "malware payday phishing replica scam spam warez",
}
#: Patterns of pages that hold no text of their own.
PAGE_PATTERNS = (r"(?i)/(wp-login|wp-admin)\.php", r"(?i)[?&]sessionid=[0-9a-f]{16,}", r"(?i)[?&]replytocom=[0-9]", r"(?i)/cgi-bin/")


def host_word_rule(rule_id: int, word: str) -> PatternRule:
    return PatternRule(rule_id, rf"(?i)^[a-z]+://([^/?#]*[.-])?{word}[.-]")


PATTERN_RULES = [host_word_rule(k, w) for k, w in enumerate(" ".join(HOST_WORDS.values()).split())]
PATTERN_RULES += [PatternRule(1000 + k, p) for k, p in enumerate(PAGE_PATTERNS)]


def read_rules(spark: SparkSession, path: str) -> list[PatternRule]:
    """Rules from a text file of one pattern a line, in order; blank lines and lines that begin with # are none."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=False).collect()]
    return [PatternRule(k, x) for k, x in enumerate(lines) if x.strip() and not x.startswith("#")]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _host_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. Rules are few and fixed: one CASE, longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("([a-z0-9]+)"), 1))


def rarest_token_index(urls: DataFrame, rules: list[PatternRule], url: str = "url") -> DataFrame:
    """(token, rule_id, pattern): each rule under the token that the fewest URLs hold (ties: first in order)."""
    spark = urls.sparkSession
    if not rules:
        return spark.createDataFrame([], "token string, rule_id int, pattern string")
    if sum(len(r.tokens) for r in rules) > MAX_BROADCAST_ROWS:
        raise ValueError("too many rule tokens for one rule table; split the rules and union the matches")
    held = spark.createDataFrame([(r.rule_id, r.pattern, t) for r in rules for t in r.tokens], "rule_id int, pattern string, token string")
    tokens = urls.select(F.explode(url_tokens(F.col(url))).alias("token"))
    seen = tokens.join(F.broadcast(held.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    best = held.join(F.broadcast(seen), "token", "left").groupBy("rule_id", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("t"))
    return best.select(F.col("t.token").alias("token"), "rule_id", "pattern")


def matches(urls: DataFrame, index: DataFrame, url: str = "url") -> DataFrame:
    """(url, matched_rules): the URLs that a pattern matches, each once, and the ids of the rules in order. A URL's tokens fetch candidates
    from the index, which is as large as the rule list (checked) and broadcast; only candidates run their expression."""
    tokens = urls.select(F.col(url).alias("__url")).withColumn("token", F.explode(url_tokens(F.col("__url"))))
    hit = tokens.join(F.broadcast(index), "token").filter(F.regexp_like("__url", F.col("pattern")))
    return hit.groupBy("__url").agg(F.sort_array(F.collect_set("rule_id")).alias("matched_rules"))


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every row's URL. Returns key, host, path, rule (null where none fits), verdict, matched_rules (ids of matching patterns).

    The longest host and path rule decides; where none fits, a matching pattern blocks, else the URL is allowed. Null or odd URLs have
    an empty host and path, no rule, and are allowed. Repeated rows are judged each for themselves; an empty table gives no rows; other
    columns are ignored. Matching URLs go back to their rows once for each salt, so a URL that very many rows hold is spread over tasks."""
    hits = matches(pages, rarest_token_index(pages, pattern_rules, url), url)
    hits = hits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    read = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url")).withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
    read = read.join(hits, ["__url", "__salt"], "left").withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    rule, verdict = _host_rule(F.col("host"), F.col("path"), host_rules)
    method = F.when(F.col("matched_rules").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    ids = F.coalesce("matched_rules", F.array().cast("array<int>")).alias("matched_rules")
    return read.select(F.col("__key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), ids)
