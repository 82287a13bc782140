"""A masked scan for personal data and secrets: where and how long, never what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ALLOWED_DOMAINS, EMAIL_RULE, IDENTITY_EXEMPT, PRIVACY_RULES, PRIVATE_NAME_RULE, PRIVATE_NAMES, is_binary


def lines_of(files: DataFrame) -> DataFrame:
    """path, line (from 1), content of (path, text)."""
    return files.select("path", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def scan(files: DataFrame, rules: dict[str, str] | None = None, allowed: tuple[str, ...] = ALLOWED_DOMAINS, strict: bool = False) -> DataFrame:
    """path, line, rule, length of the first match of each rule in each line.

    Addresses that end in an allowed domain are let pass; with ``strict`` the domain must be
    that one or below it, and every address of the line counts, not only the first.
    """
    return _scan_lines(lines_of(files), rules, allowed, strict)


def _scan_lines(lines: DataFrame, rules: dict[str, str] | None, allowed: tuple[str, ...] = ALLOWED_DOMAINS, strict: bool = False) -> DataFrame:
    rules = PRIVACY_RULES if rules is None else rules

    def matches(name: str, pattern: str) -> Column:
        unicode = "(?U)" + pattern
        if name != EMAIL_RULE:
            return F.slice(F.regexp_extract_all("content", F.lit(unicode), 0), 1, 1)
        found = F.regexp_extract_all("content", F.lit(unicode), 0)
        if strict:
            return F.filter(found, lambda m: ~F.exists(F.array(*map(F.lit, allowed)), lambda d: F.endswith(m, F.concat(F.lit("@"), d)) | F.endswith(m, F.concat(F.lit("."), d))))
        return F.filter(F.slice(found, 1, 1), lambda m: ~F.exists(F.array(*map(F.lit, allowed)), lambda d: F.endswith(m, d)))

    def hits(name: str, pattern: str) -> Column:
        return F.transform(matches(name, pattern), lambda m: F.struct(F.lit(name).alias("rule"), F.char_length(m).alias("length")))

    found = [hits(n, p) for n, p in rules.items()]
    return lines.select("path", "line", F.explode(F.concat(*found)).alias("hit")).select("path", "line", "hit.rule", "hit.length")


def private_names(files: DataFrame) -> DataFrame:
    """path, line 0, rule, length of paths that name personal papers; only the path is looked at, in any case of letters."""
    found = F.regexp_extract("path", "(?iu)" + PRIVATE_NAMES, 0)
    return files.where(found != "").select("path", F.lit(0).alias("line"), F.lit(PRIVATE_NAME_RULE).alias("rule"), F.char_length(found).alias("length"))


def scan_files(raw: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The hits of files (path, content): in their names, and in the contents of those that aren't binary, read as UTF-8."""
    texts = raw.where(~is_binary(F.col("content"))).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("valid"), F.make_valid_utf8(F.col("content").cast("string")).alias("made"))
    return scan(texts.select("path", F.coalesce("valid", "made").alias("text")), rules).unionByName(private_names(raw))


def scan_messages(messages: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The hits of commit messages (path, text); lines that begin with "#" will not be kept and don't count."""
    return _scan_lines(lines_of(messages).where(~F.ltrim("content").startswith("#")), rules)


def scan_history(diffs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The hits of commits with their diffs (path, text): a sign in front of a line isn't part of it, a line that names a file isn't looked at.

    ``path`` of a hit is the commit's, a colon, and the file that the diff is in by then.
    """
    named = F.regexp_extract("content", r"^\+\+\+ b/(.+)$", 1)
    by_line = Window.partitionBy("path").orderBy("line")
    lines = lines_of(diffs).withColumn("named", F.nullif(named, F.lit("")))
    file = F.coalesce(F.last("named", ignorenulls=True).over(by_line), F.lit("(commit message)"))
    lines = lines.withColumn("path", F.concat("path", F.lit(":"), file)).where("named is null")
    return _scan_lines(lines.withColumn("content", F.regexp_replace("content", "^[+-]", "")).drop("named"), rules)


def identity_hits(identities: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """identity, rule of identities that hold personal numbers or paths, or aren't among ``allowed`` (identity; in any case of letters; empty: all are)."""
    rules = {k: v for k, v in PRIVACY_RULES.items() if k not in IDENTITY_EXEMPT}
    found = F.array_compact(F.array(*[F.when(F.regexp_like("identity", F.lit("(?U)" + v)), F.concat(F.lit("身份含"), F.lit(k))) for k, v in rules.items()]))
    hits = identities.select("identity", F.explode(found).alias("rule"))
    if allowed is None:
        return hits
    known = allowed.select(F.lower(F.btrim("identity")).alias("known")).where("known <> ''").distinct()
    any_known = F.broadcast(known.agg((F.count("*") > 0).alias("listed")))  # one row
    strange = identities.join(known, F.lower("identity") == F.col("known"), "left_anti").join(any_known).where("listed")
    return hits.unionByName(strange.select("identity", F.lit("不在允许清单内 (原文已隐去)").alias("rule")))


def summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"), F.max("length").alias("longest"))


def identities(commits: DataFrame) -> DataFrame:
    """identity, n: in how many commits someone is author or committer."""
    return commits.select(F.explode(F.array_distinct(F.array("author", "committer"))).alias("identity")).where("identity is not null").groupBy("identity").agg(F.count("*").alias("n"))
