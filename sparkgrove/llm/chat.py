"""Chat formatting with Spark expressions only.

A conversation becomes one string. Each run of adjacent turns of one role is ``### role: part</part>part</turn>`` and a
line feed. Inside texts a backslash is doubled and one is put inside ``</`` and between each two ``#`` of a run (and inside
``: `` in roles), so that no text holds ``###`` or ``</`` and ``parse`` gives back every turn.

Turns are gathered in blocks of ``BLOCK`` turn numbers first and the blocks' strings then joined, so a long conversation
isn't gathered turn by turn in one task; only its finished string is one value, as it must be.

Defined results: turns go by (turn, role, text), nulls first, so ties and repeated rows have a fixed order and all stay;
a null text or role is empty; a null conversation id is a conversation of its own; no rows give no rows; other columns of
the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
# Fixed values of the template.
OPEN, AFTER_ROLE, PART, CLOSE = "### ", ": ", "</part>", "</turn>\n"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\", "\\\\"), "</", "<\\/"), "##", "#\\#")


def unescape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "#\\#", "##"), "<\\/", "</"), "\\\\", "\\")


def _escape_role(role: Column) -> Column:
    return _replace(escape(role), ": ", ":\\ ")


def _unescape_role(role: Column) -> Column:
    return unescape(_replace(role, ":\\ ", ": "))


def _glue(before: Column, after: Column) -> Column:
    """What stands between two neighbours with these (escaped) roles."""
    return F.when(before == after, F.lit(PART)).otherwise(F.concat(F.lit(CLOSE + OPEN), after, F.lit(AFTER_ROLE)))


def _joined(pieces: Column, body: str, first: str, last: str) -> Column:
    """The pieces' bodies in order with glue between them: a piece looks at its left neighbour's last role."""
    before = F.concat(F.array(F.element_at(pieces, 1)), F.slice(pieces, 1, F.size(pieces) - 1))
    pairs = F.arrays_zip(pieces.alias("now"), before.alias("old"))
    return F.array_join(F.transform(pairs, lambda p, i: F.when(i == 0, p["now"][body]).otherwise(F.concat(_glue(p["old"][last], p["now"][first]), p["now"][body]))), "")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted and n_rows (the turns that went in), one row per conversation."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / BLOCK).alias("block"),
        F.struct(F.col(turn_col).alias("turn"), _escape_role(F.coalesce(F.col(role_col), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).alias("turn"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    blocks = blocks.select(
        "conv_id",
        F.struct(
            "block", F.element_at("turns", 1)["role"].alias("first"), F.element_at("turns", -1)["role"].alias("last"),
            _joined(F.col("turns"), "text", "role", "role").alias("body"), F.size("turns").alias("n"),
        ).alias("piece"),
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select(
        "conv_id",
        F.concat(F.lit(OPEN), F.element_at("pieces", 1)["first"], F.lit(AFTER_ROLE), _joined(F.col("pieces"), "body", "first", "last"), F.lit(CLOSE)).alias("formatted"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_rows"),
    )


def parse(formatted: Column) -> Column:
    """The runs of a formatted conversation: array of (role, parts), unescaped."""
    runs = F.split(formatted, CLOSE)
    runs = F.slice(runs, 1, F.size(runs) - 1)
    return F.transform(
        runs,
        lambda run: F.struct(
            _unescape_role(F.substring(F.substring_index(run, AFTER_ROLE, 1), F.lit(len(OPEN) + 1), F.char_length(run))).alias("role"),
            F.transform(F.split(F.substring(run, F.char_length(F.substring_index(run, AFTER_ROLE, 1)) + len(AFTER_ROLE) + 1, F.char_length(run)), PART), unescape).alias("parts"),
        ),
    )


def loss_mask(formatted: Column, learn: str = "assistant") -> Column:
    """The mask over the formatted string as runs of (chars, loss), which add up to its length in code points.

    Under the mask stand the escaped texts of the role that is learnt, without marks.
    """
    runs = F.split(formatted, CLOSE)
    runs = F.slice(runs, 1, F.size(runs) - 1)

    def of(run: Column) -> Column:
        head = F.char_length(F.substring_index(run, AFTER_ROLE, 1)) + len(AFTER_ROLE)
        own = F.substring_index(run, AFTER_ROLE, 1) == OPEN + learn
        parts = F.split(F.substring(run, head + 1, F.char_length(run)), PART)
        bits = F.flatten(F.transform(parts, lambda p, i: F.array(F.struct(F.when(i == 0, head).otherwise(len(PART)).alias("chars"), F.lit(False).alias("loss")), F.struct(F.char_length(p).alias("chars"), own.alias("loss")))))
        return F.concat(bits, F.array(F.struct(F.lit(len(CLOSE)).alias("chars"), F.lit(False).alias("loss"))))

    return F.flatten(F.transform(runs, of))


def conversation_digest(turns: DataFrame) -> DataFrame:
    """Formats all conversations and reads every figure back from the formatted strings."""
    read = format_conversations(turns).select("conv_id", "formatted", parse(F.col("formatted")).alias("runs"))
    texts = F.flatten(F.transform(F.filter("runs", lambda r: r["role"] == "assistant"), lambda r: r["parts"]))
    read = read.select(
        "conv_id",
        "formatted",
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + F.size(r["parts"])).alias("n_turns"),
        F.size("runs").cast("long").alias("n_runs"),
        F.array_join(F.flatten(F.transform("runs", lambda r: F.transform(r["parts"], lambda p: F.concat(r["role"], F.lit("\n"), p, F.lit("\n"))))), "").alias("lines"),
        F.array_join(texts, "").alias("loss"),
    )
    return read.select(
        "conv_id", "n_turns", F.sha2(F.encode("lines", "UTF-8"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "n_runs",
    )


#: The same result in DuckDB's SQL, from the turns and the template instead of the formatted strings.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</', '<\/'), '##', '#\#') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '</', '<\/'), '##', '#\#'), ': ', ':\ ') AS name,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN same THEN length('</part>') ELSE length('### ') + length(name) + length(': ') + length('</turn>') + 1 END) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (NOT same) AS BIGINT) AS n_runs
FROM escaped GROUP BY conv_id
"""
