"""Recurring lines of verdict logs: a log-template tree of token counts and leading tokens.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.llm.common import join_back, written

SHORT_TOKENS = 5         # shorter lines are compared literally if digits would leave all their tokens open
DEPTH = 2                # leading tokens that are levels of the tree
SEGMENTS = 4             # parts of the rest of a line, one of which may vary
VARY_TOKENS = 12         # lines from this length on may vary in one part
COUNTS = ("n_lines", "n_dropped")


def tokens_of(line: Column) -> Column:
    """Tokens of a line at white space, those with a digit as ``<*>`` unless a short line has no other tokens."""
    def squeezed(text):
        return F.trim(F.regexp_replace(text, r"\s+", " "))
    masked = squeezed(F.regexp_replace(line, r"\S*[0-9]\S*", "<*>"))
    all_open = masked.rlike(rf"^<\*>( <\*>){{0,{SHORT_TOKENS - 2}}}$")
    return F.split(F.when(line.rlike("[0-9]"), F.when(all_open, squeezed(line)).otherwise(masked))
                   .otherwise(squeezed(line)), " ")


def line_keys(lines: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """One row per line and template it falls under: ``keep``, template.

    The path to a leaf is the number of tokens and the leading ones; the rest is cut into ``SEGMENTS`` parts of
    equal length (the last takes what is over), and a leaf's templates are the whole rest and the rest with one
    part left open.  Blank lines fall under none.  Each step is a projection of its own, so that tokens and hashes are
    computed once.
    """
    cut = lines.where(F.col(line).rlike(r"\S")).select(
        *keep, tokens_of(F.col(line)).alias("tokens")).select("*", F.size("tokens").alias("n"))
    step = F.floor((F.col("n") - DEPTH) / SEGMENTS).cast("int")
    hashed = cut.select(
        *keep, "n", F.xxhash64("n", F.slice("tokens", 1, DEPTH)).alias("lead"),
        *(F.when(F.col("n") >= VARY_TOKENS, F.xxhash64(F.slice(
            "tokens", F.lit(DEPTH + 1) + step * i, F.col("n") - DEPTH - step * i if i == SEGMENTS - 1 else step)))
          .alias(f"p{i}") for i in range(SEGMENTS)),
        F.xxhash64(F.slice("tokens", DEPTH + 1, F.col("n"))).alias("rest"))
    whole = F.xxhash64(F.lit(-1), "lead", "rest")
    open_at = [F.xxhash64(F.lit(i), "lead", *(f"p{j}" for j in range(SEGMENTS) if j != i)) for i in range(SEGMENTS)]
    keys = F.when(F.col("n") >= VARY_TOKENS, F.array(whole, *open_at)).otherwise(F.array(whole))
    return hashed.select(*keep, F.explode(keys).alias("template"))


def drop_recurring_lines(rows: DataFrame, key: str = "name", text: str = "verdict") -> DataFrame:
    """Verdict rows without the lines whose template an earlier text (smaller key) already has.

    A line belongs to the template of its token count, leading tokens and rest, and from ``VARY_TOKENS`` tokens on
    also to those with one quarter of the rest left open; blank lines belong to none.  Tokens with digits are open,
    but for lines of fewer than ``SHORT_TOKENS`` tokens that would be open altogether.  Where texts share a template,
    the text with the smallest key keeps its lines, so one copy of every passage stays.  Lines repeated within one
    text only stay.  Returns all columns of ``rows``, with ``text`` rewritten, and ``n_lines``, ``n_dropped`` (long),
    which replace columns of these names.

    Null texts stay null with no lines; a null key never counts as earlier and keeps its lines; rows that agree in
    key and text get the same result; texts may be of any length; an empty table gives none.

    Keys are reduced to the smallest key of a text per template with partial sums, so a line in a third of all
    texts is one row per task.  Only recurring templates go back to the lines: those with more than a thousandth of
    all keys (at most 1,000) to every task, the others by a join.
    """
    names = rows.columns
    row = rows.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"))
    lines = row.where("key is not null and text is not null").select(
        "key", "print", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = written(line_keys(lines, "line", ["key", "print", "at"]), "line-keys")
    found = keyed.groupBy("template").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
    recurring = written(found.where("first < last").select("template", "first", "n"), "templates")
    dropped = (join_back(keyed, recurring, "template", "n", keyed.count()).where(F.col("first") < F.col("key"))
               .groupBy("key", "print").agg(F.collect_set("at").alias("gone")))
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(key).alias("own_key"),
                      F.xxhash64(F.col(text)).alias("own_print"), F.split(F.col(text), "\n", -1).alias("lines"))
    back = own.join(dropped, (F.col("own_key") == F.col("key")) & (F.col("own_print") == F.col("print")), "left")
    all_at = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_sort(F.array_except(all_at, "gone")), lambda i: F.element_at("lines", i + 1))
    new = F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(kept, "\n"))
    return back.select(
        *(new.alias(c) if c == text else F.col(f"row.`{c}`") for c in names if c not in COUNTS),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
