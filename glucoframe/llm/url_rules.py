"""URL filter rules, indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.session import broadcast_if_small

MOST_BROADCAST_RULES = 50_000
ANY_TOKEN = ""  # rules without a usable token are candidates for every URL
_PARTS = re.compile(r"\|\||\||\*|\^|[A-Za-z0-9]+|.", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """A pattern with its verdict, `block` or `allow`.

    `||` at the start stands for the start of the host or of one of its domains, `|` at either end for that end of
    the address, `*` for anything, `^` for a separator or the end. All else is literal. The address is the host with
    A-Z lower-cased and what follows it. `fold` ignores the case of A-Z in the rest too.
    """

    text: str
    verdict: str
    pattern: str
    fold: bool = True

    def regex(self) -> str:
        """For Java and RE2 alike."""
        parts, out = _PARTS.findall(self.pattern), []
        for at, part in enumerate(parts):
            if part == "||" and at == 0:
                out.append(r"^(?:[^/?#]*\.)?")
            elif part == "|" and at == 0:
                out.append("^")
            elif part == "|" and at == len(parts) - 1:
                out.append(r"\z")
            elif part == "*":
                out.append(".*")
            elif part == "^":
                out.append(r"(?:[^A-Za-z0-9_.%-]|\z)")
            else:
                literal = part.translate({k: k + 32 for k in range(65, 91)}) if self.fold else part
                out.append(re.sub(r"([^A-Za-z0-9\x80-\U0010ffff])", r"\\\1", literal))
        return "(?s)" + "".join(out)

    def tokens(self) -> list[str]:
        """Letter and digit runs that any matching address holds as whole tokens: both ends are fixed by the pattern."""
        parts = _PARTS.findall(self.pattern)
        fixed = lambda at: 0 <= at < len(parts) and parts[at] != "*" and not parts[at].isalnum()
        whole = [p.lower() for at, p in enumerate(parts) if re.fullmatch("[A-Za-z0-9]+", p) and fixed(at - 1) and fixed(at + 1)]
        return sorted(set(whole))


def prefix_rule(text: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the path starts with the rule's. Case counts."""
    return Rule(text, verdict, "||" + text, fold=False)


def block(pattern: str) -> Rule:
    return Rule(pattern, "block", pattern)


def allow(pattern: str) -> Rule:
    return Rule("@@" + pattern, "allow", pattern)


PREFIX_RULES = (
    prefix_rule("net/", "block"), prefix_rule("example.net/en/", "allow"),
    prefix_rule("example.com/de/", "block"), prefix_rule("org/fr/", "allow"),
)
PATTERN_RULES = (
    block("||spam-farm."), block("||cheap-pills."), block("||casino-win."), block("||free-bets."), block("||adult-x."),
    block("||ads-track."), block("/ads/"), block("/banner/*.gif"), block("^click?id="), block("||doubleclick."),
    allow("||example.org^*/help/"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def address(url: Column) -> dict[str, Column]:
    """host, path and rest (all after the host). All are empty for null or where :// is missing."""
    piece = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)(([^?#]*).*)$", k), F.lit(""))
    return {"host": ascii_lower(piece(1)), "path": piece(3), "rest": piece(2)}


def rule_table(spark: SparkSession, rules: Sequence[Rule], first: bool) -> DataFrame:
    """(first, rule, size, verdict, regex, fold, tokens); size: code points of the rule's text."""
    made = [
        F.struct(
            F.lit(first).alias("first"), F.lit(r.text).alias("rule"), F.lit(len(r.text)).alias("size"), F.lit(r.verdict).alias("verdict"),
            F.lit(r.regex()).alias("regex"), F.lit(r.fold).alias("fold"), F.array(*[F.lit(t) for t in r.tokens()]).cast("array<string>").alias("tokens"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*made))) if made else spark.sql(
        "SELECT true AS first, '' AS rule, 0 AS size, '' AS verdict, '' AS regex, true AS fold, array('') AS tokens WHERE false")


def indexed(rules: DataFrame, words: DataFrame) -> DataFrame:
    """The rules with the one token of theirs that the fewest of the given rows (column token) hold."""
    wanted = broadcast_if_small(rules.select(F.explode("tokens").alias("token")).distinct(), MOST_BROADCAST_RULES)
    counts = words.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    options = rules.withColumn("token", F.explode_outer("tokens")).join(counts, "token", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit(ANY_TOKEN)).alias("token"))
    own = ["first", "rule", "size", "verdict", "regex", "fold"]
    return options.groupBy(*own).agg(F.min(rank)["token"].alias("token"))


def judge(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
    prefix_rules: Sequence[Rule] = PREFIX_RULES, pattern_rules: Sequence[Rule] = PATTERN_RULES,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern.

    The longest prefix rule that fits decides and is named in `rule` (of equally long ones the last by code point).
    Otherwise an allowing pattern beats a blocking one (`pattern` names the last by code point of those that decide),
    and no match means allow.

    Each URL is cut into letter and digit runs. They fetch the rules whose rarest run they are, by a hash join whose
    rule side is broadcast up to MOST_BROADCAST_RULES rules, and only those rules' expressions run. The matches of a
    URL are reduced to one row before the shuffle.

    Null urls and urls without :// have no host, fit no rule and are allowed. Null and repeated ids or urls: every row
    is judged by its url. Further columns are ignored; empty tables give no rows, empty rule lists allow everything.
    """
    parts = address(F.col("url"))
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"))
    split = rows.where("url IS NOT NULL").select("url", parts["host"].alias("host"), parts["rest"].alias("rest")).where("host != '' OR rest != ''")
    whole = F.concat("host", "rest")
    runs = F.split(F.regexp_replace(ascii_lower(whole), "[^a-z0-9]+", " "), " ")
    tokens = F.array_distinct(F.concat(F.array(F.lit(ANY_TOKEN)), runs))
    words = split.select("url", whole.alias("address"), F.explode(tokens).alias("token"))

    spark = pages.sparkSession
    rules = rule_table(spark, prefix_rules, True).union(rule_table(spark, pattern_rules, False))
    index = indexed(rules, words.select("token"))
    index = F.broadcast(index) if len(prefix_rules) + len(pattern_rules) <= MOST_BROADCAST_RULES else index
    fetched = words.join(index, "token")
    spelled = F.when(F.col("fold"), ascii_lower(F.col("address"))).otherwise(F.col("address"))
    fits = fetched.where(F.regexp_like(spelled, F.col("regex")))
    by = lambda condition, value: F.max(F.when(condition, value))
    decided = fits.groupBy(F.col("url").alias("of")).agg(
        by(F.col("first"), F.struct("size", "rule", "verdict")).alias("prefix"),
        by(~F.col("first") & (F.col("verdict") == "allow"), F.col("rule")).alias("allowing"),
        by(~F.col("first") & (F.col("verdict") == "block"), F.col("rule")).alias("blocking"),
    )
    judged = rows.join(decided, F.col("url") == F.col("of"), "left")
    free = F.when(F.col("allowing").isNull() & F.col("blocking").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", parts["host"].alias("host"), parts["path"].alias("path"), F.col("prefix.rule").alias("rule"),
        F.coalesce("prefix.verdict", free).alias("verdict"), F.when(F.col("prefix").isNull(), F.coalesce("allowing", "blocking")).alias("pattern"),
    )
