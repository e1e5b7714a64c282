"""Conversations in reply order without quotations, in DataFrame functions alone.

Lines of a message carry a quote level: the number of ``>`` before them. Runs of lines of one level are quoted passages;
a line that only announces a quotation ("... wrote:") goes with it. Passages, paragraphs, lines and whole messages are
normalised (lower case, single blanks) and hashed; a quoted passage, or else its paragraphs (parted by empty quoted
lines) and lines, is joined to the earliest message of the same conversation that says it in its own words, if that
message is earlier. A quoted word counts as part of its paragraph where that has more words than its lines found.
The SQL has no keys for quoted paragraphs: the two differ where a part of a message is quoted with lines wrapped anew. A message replies to what it
quotes at its lowest level; of several such messages to the one with most quoted words, then the latest. Replies follow
their thread's first message: the order inside a conversation is by first message of the thread, then by turn, so a
message never stands before the one it replies to. Messages without a linked quotation begin threads of their own.

Null texts and texts of quotations alone are empty messages; texts without quotations stay as they are. Null ids form one
conversation; null turns come first and quote nothing. Repeated rows stay, next to each other. Other columns are not
read. Hot conversations are cut into chunks for numbering, hot messages are spread over salted copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import number, ordered
from .shared import query, salted_join, stored, table

MARK = r"^[ \t]*>[> \t]*"
#: A line that announces a quotation, in four languages.
ANNOUNCES = r"(?i)^.*\b(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
BLANKS = r"[ \t\n\x0B\f\r]+"
ID = ["c0", "conv", "t"]


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n", -1)


def own_text(text: Column) -> Column:
    """The message without quoted lines and what announces them; blank lines around it go too if there were any."""
    lines = F.transform(_lines(text), lambda x: F.struct(x.alias("x"), _level(x).alias("level")))

    def kept(lines: Column) -> Column:
        def own(line: Column, i: Column) -> Column:
            before_quote = F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
            return F.when((line["level"] == 0) & ~(before_quote & line["x"].rlike(ANNOUNCES)), line["x"])

        bare = F.array_join(F.filter(F.transform(lines, own), lambda x: x.isNotNull()), "\n")
        return F.when(F.exists(lines, lambda x: x["level"] > 0), F.regexp_replace(bare, r"^[ \t\n]+|[ \t\n]+$", "")).otherwise(text)

    return F.transform(F.array(lines), kept)[0]


def _sayings(messages: DataFrame) -> DataFrame:
    """(key, said): the earliest turn at which a conversation says a message, paragraph or line in its own words."""
    whole = F.array(F.col("own"))
    said = F.concat(whole, F.split("own", r"(?>\r\n|\r|\n)[ \t]*(?>\r\n|\r|\n)", -1), F.split("own", r"\n", -1))
    rows = messages.where("turn is not null").select("c0", "conv", "turn", F.explode(F.array_distinct(F.transform(said, normalised))).alias("saying"))
    key = F.concat_ws(":", F.xxhash64("c0", "conv", "saying"), F.xxhash64(F.lit(9), "c0", "conv", "saying"))
    return rows.where("saying <> ''").groupBy(key.alias("key")).agg(F.min("turn").alias("said"))


WHOLE, LINE, PARAGRAPH = 0, 1, 2


def _quoted(messages: DataFrame) -> DataFrame:
    """(message, level, run, part, kind, key, words): the quoted passages of messages, their paragraphs and their lines."""
    lines = messages.where(F.col("text").rlike("(?m)" + MARK)).select(*ID, "turn", F.posexplode(_lines(F.col("text"))).alias("p", "x"))
    lines = lines.withColumn("level", _level(F.col("x"))).withColumn("said", normalised(F.regexp_replace("x", MARK, "")))
    order = Window.partitionBy(*ID, "turn").orderBy("p")
    lines = lines.withColumn("new", F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1))
    lines = lines.withColumn("run", F.sum("new").over(order)).where("level > 0")
    runs = lines.groupBy(*ID, "turn", "run", "level").agg(F.array_sort(F.collect_list(F.struct("p", "said"))).alias("of"))

    def saying(kind: int, part: Column, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), part.alias("part"), said.alias("saying"))

    def paragraph(of: Column, i: Column) -> Column:
        lines = F.transform(F.split(of, "\n", -1), lambda x: saying(LINE, i, x))
        return F.concat(F.array(saying(PARAGRAPH, i, normalised(of))), lines)

    paragraphs = F.split(F.array_join(F.col("of.said"), "\n"), "\n\n+", -1)
    whole = saying(WHOLE, F.lit(0), normalised(F.array_join(F.col("of.said"), " ")))
    sayings = F.concat(F.array(whole), F.flatten(F.transform(paragraphs, paragraph)))
    said = runs.select(*ID, "turn", "level", "run", F.inline(sayings)).where("saying <> ''")
    said = said.groupBy(*ID, "turn", "level", "run", "saying").agg(F.min(F.struct("kind", "part")).alias("of"))
    key = F.concat_ws(":", F.xxhash64("c0", "conv", "saying"), F.xxhash64(F.lit(9), "c0", "conv", "saying"))
    return said.select(*ID, "turn", "level", "run", "of.part", "of.kind", key.alias("key"), F.size(F.split("saying", " ")).alias("words"))


def _replies(messages: DataFrame) -> DataFrame:
    """(c0, conv, t, turn, reply_to) of the messages with a linked quotation; t tells rows of the same turn apart."""
    linked = salted_join(stored(_quoted(messages)), _sayings(messages), "key").where("said < turn")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("words"))), F.lit(0))
    by = [*ID, "turn", "level", "said"]
    parts = linked.groupBy(*by, "run", "part").agg(of(WHOLE).alias("whole"), of(LINE).alias("lines"), of(PARAGRAPH).alias("paragraph"))
    runs = parts.groupBy(*by, "run").agg(
        F.sum("whole").alias("whole"), F.sum("lines").alias("lines"), F.sum(F.greatest("lines", "paragraph")).alias("parts")
    )
    votes = runs.groupBy(*by).agg(F.sum(F.when(F.col("whole") > 0, F.col("whole") + F.col("lines")).otherwise(F.col("parts"))).alias("words"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "words", "said"))
    return stored(votes.groupBy(*ID, "turn").agg(best.alias("best")).select(*ID, "turn", F.col("best.said").alias("reply_to")))


def _threads(replies: DataFrame) -> DataFrame:
    """(c0, conv, t, reply_to, root): the first message of the thread, by doubling the step in every round."""
    place = lambda turn: F.concat_ws(":", "c0", "conv", turn)
    # Of several rows with one turn the earliest reply stands for the turn.
    up = replies.groupBy(place("turn").alias("key")).agg(F.min("reply_to").alias("next"))
    now = stored(replies.withColumn("root", F.col("reply_to")).withColumn("key", place("root")))
    while True:
        up = stored(up)
        stepped = stored(salted_join(now, up, "key", "left"))
        if stepped.where("next is not null").isEmpty():
            return now.select(*ID, "reply_to", "root")
        moved = stepped.withColumn("root", F.coalesce("next", "root")).drop("next", "key")
        now = stored(moved.withColumn("key", place("root")))
        far = up.withColumn("conv_key", F.regexp_extract("key", r"^(.*):[^:]*$", 1))
        far = far.withColumn("at", F.concat_ws(":", "conv_key", "next")).withColumnRenamed("next", "near")
        again = salted_join(stored(far), up.select(F.col("key").alias("at"), "next"), "at", "left")
        up = again.select("key", F.coalesce("next", "near").alias("next"))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position (from 0), turn, role, text without quotations, reply_to, thread (its first turn), formatted."""
    rows = messages.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    # Numbering wants keys and orders without nulls.
    rows = rows.select(
        "*",
        F.col("conv_id").isNull().cast("int").alias("c0"),
        F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"),
        F.xxhash64("turn", "role", "text").alias("t"),
        own_text(F.coalesce("text", F.lit(""))).alias("own"),
    )
    distinct = rows.select(*ID, "turn", "text", "own").dropDuplicates([*ID, "turn"])
    threads = _threads(_replies(distinct)).withColumnRenamed("reply_to", "said")
    same = [F.col(f"r.{c}") == F.col(f"h.{c}") for c in ID]
    joined = rows.alias("r").join(threads.alias("h"), same[0] & same[1] & same[2], "left").select("r.*", "h.said", "h.root")
    joined = joined.withColumn("t0", F.coalesce("turn", F.lit(-(1 << 62)))).withColumn("root0", F.coalesce("root", "t0"))
    placed = ordered(joined.drop("text"), ["c0", "conv"], ["root0", "t0", "t"]).add(position=number()).df
    own = F.coalesce("own", F.lit(""))
    return placed.select(
        "conv_id",
        (F.col("position") - 1).cast("long").alias("position"),
        "turn",
        "role",
        own.alias("text"),
        F.col("said").alias("reply_to"),
        F.coalesce("root", "turn").alias("thread"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), own, F.lit("\n")).alias("formatted"),
    )


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


OP10_SQL = f"""with recursive m as (select row_number() over () as r, conv_id, turn, role, coalesce(text, '') as text from conversations),
  l as (select r, unnest(range(len(ls))) as p, unnest(ls) as x from (select r, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from m)),
  k as (select *, length(regexp_replace(regexp_extract(x, '{MARK}'), '[^>]', '', 'g')) as level, regexp_replace(x, '{MARK}', '') as body from l),
  n as (select *, coalesce(lead(level) over w, 0) as after, case when level = lag(level) over w then 0 else 1 end as new from k window w as (partition by r order by p)),
  o as (select m.*, case when bool_or(level > 0) then regexp_replace(coalesce(string_agg(x, chr(10) order by p) filter (level = 0 and not (after > 0 and regexp_matches(x, '{ANNOUNCES}'))), ''), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')
    else any_value(text) end as own from m join n using (r) group by m.r, conv_id, turn, role, text),
  y as (select conv_id, saying, min(turn) as said from (select conv_id, turn, {_norm("unnest([own] || regexp_split_to_array(own, '\\n[ \\t]*\\n') || string_split(own, chr(10)))")} as saying from o where turn is not null)
    where saying <> '' group by 1, 2),
  u as (select *, sum(new) over (partition by r order by p) as run from n),
  q as (select r, run, level, [{_norm("string_agg(" + _norm("body") + ", ' ' order by p)")}] || list({_norm("body")}) as says from u where level > 0 group by 1, 2, 3),
  d as (select r, run, level, unnest(list_distinct(says)) as saying from q),
  v as (select o.r, level, said, sum(len(string_split(d.saying, ' '))) as words from d join o on o.r = d.r join y on y.conv_id is not distinct from o.conv_id and y.saying = d.saying
    where d.saying <> '' and said < o.turn group by 1, 2, 3),
  a as (select r, arg_max(said, (-level, words, said)) as reply_to from v group by 1),
  z as (select conv_id, turn, min(reply_to) as up from a join m using (r) group by 1, 2),
  t(r, conv_id, root) as (select r, conv_id, reply_to from a join m using (r) union all select t.r, t.conv_id, z.up from t join z on z.conv_id is not distinct from t.conv_id and z.turn = t.root),
  h as (select r, min(root) as root from t group by 1)
select conv_id, row_number() over (partition by conv_id order by coalesce(root, turn) nulls first, turn nulls first) - 1 as position, turn, role, own as text, reply_to,
  coalesce(root, turn) as thread, '<|' || coalesce(role, '') || '|>' || chr(10) || own || chr(10) as formatted from o left join a using (r) left join h using (r)"""


@query("op10_quotation_linking", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(table(spark, folder, "conversations"))
