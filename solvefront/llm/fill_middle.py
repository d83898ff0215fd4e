"""Fill-in-the-middle transformation by escaped marker injection, in column functions alone.

A delimiter is escaped in the text and then appended after each unit, so the
units are counted by counting delimiters, and ``substring_index`` takes out the
parts between two of them.  Parts are unescaped and assembled under sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvefront.llm.common import let, sealed

#: Lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")
#: The delimiter, and the character that stands before what replaces it or itself.
DELIMITER, ESCAPE = "\x1e", "\x1b"


def escaped(text: Column) -> Column:
    """The text without the delimiter: the escape character becomes itself and an ``e``, the delimiter an escape and a ``d``."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """The inverse of :func:`escaped` on a part between units; delimiters left inside it go."""
    plain = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def marked(text: Column, unit: str = LINES) -> Column:
    """The escaped text with a delimiter after each unit.

    ``unit`` is a pattern whose matches, left to right, cover any text, and
    which no escape sequence changes: it may tell line ends and the like
    apart, but neither of the two control characters.
    """
    return F.regexp_replace(escaped(text), F.lit(unit), F.lit("$0" + DELIMITER))


def units(mark: Column) -> Column:
    return (F.length(mark) - F.length(F.replace(mark, F.lit(DELIMITER), F.lit("")))).cast("long")


def parts(mark: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """(prefix, middle, suffix): units before ``low``, up to ``high``, and after it."""
    index = lambda text, count: F.call_function("substring_index", text, F.lit(DELIMITER), count)
    low, high, n = low.cast("int"), high.cast("int"), n.cast("int")
    before = index(mark, high)
    return unescaped(index(mark, low)), unescaped(index(before, low - high)), unescaped(index(mark, high - n - 1))


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed, colon and key; a null key counts as the text 'null'."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text an output was made from.

    A transformed text holds each marker once: its text held none, and no
    marker's end is another's beginning, so none arises where parts meet.
    """
    p, s, m = markers
    after = lambda text, x: F.call_function("substring_index", text, F.lit(x), F.lit(-1))
    before = lambda text, x: F.call_function("substring_index", text, F.lit(x), F.lit(1))
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    df: DataFrame, text: str = "text", key: str = "doc_id", *, unit: str = LINES, rate: int = 100, spm_rate: int = 50, seed: str = "7",
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output.

    The two cuts are the draws of the key modulo the units plus one; ``rate``
    of a hundred texts are transformed, ``spm_rate`` of these suffix first.
    Null and empty texts, and texts that hold a marker, stay plain: their
    output is the text (null: empty), their part lengths are null.  Equal cuts
    leave an empty middle.  Rows that repeat a key share its draws; null keys
    share theirs.  All of a row is made within the row, so an empty table
    stays empty and nothing is shuffled; a text takes a few times its own size.
    Columns of these names in ``df`` are replaced.
    """
    box = sealed(df)
    t = F.coalesce(F.col(box.name(text)), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(box.name(key)), seed)
    held = F.greatest(*[F.contains(t, F.lit(m)) for m in markers])
    form = F.when((t == "") | held | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    p, s, m = (F.lit(x) for x in markers)

    def made(d: Column) -> Column:
        mark, n = d["mark"], d["n"]
        ends = F.struct((d["h1"] % (n + 1)).alias("a"), (d["h2"] % (n + 1)).alias("b"))

        def assemble(c: Column) -> Column:
            prefix, middle, suffix = parts(mark, n, F.least(c["a"], c["b"]), F.greatest(c["a"], c["b"]))

            def output(x: Column) -> Column:
                joined = F.when(d["form"] == "spm", F.concat(s, x["suffix"], p, x["prefix"], m, x["middle"])).otherwise(F.concat(p, x["prefix"], s, x["suffix"], m, x["middle"]))
                return F.struct(n.alias("n"), F.length(x["prefix"]).cast("long").alias("prefix_chars"), F.length(x["middle"]).cast("long").alias("middle_chars"), joined.alias("output"))

            return let(F.struct(prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix")), output)

        plain = F.struct(n.alias("n"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), d["text"].alias("output"))
        return F.when(d["form"] == "plain", plain).otherwise(let(ends, assemble))

    def counted(d: Column) -> Column:
        return let(F.struct(d["mark"].alias("mark"), units(d["mark"]).alias("n"), d["h1"].alias("h1"), d["h2"].alias("h2"), d["form"].alias("form"), d["text"].alias("text")), made)

    first = F.struct(marked(t, unit).alias("mark"), h1.alias("h1"), h2.alias("h2"), form.alias("form"), t.alias("text"))
    out = box.df.withColumn("_fim", let(first, lambda d: F.struct(d["form"].alias("form"), counted(d).alias("made"))))
    made_of = {"n": "made.n", "form": "form", "prefix_chars": "made.prefix_chars", "middle_chars": "made.middle_chars", "output": "made.output"}
    passed = [F.col(box.name(c)).alias(c) for c in df.columns if c not in made_of]
    return out.select(*passed, *[F.col(f"_fim.{place}").alias(c) for c, place in made_of.items()])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || COALESCE(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
e AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:n], '') AS suffix
  FROM e)
SELECT doc_id, n, form,
  CASE WHEN form != 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form != 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
