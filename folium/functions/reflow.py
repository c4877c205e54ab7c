"""Wrapped lines and broken words of plain text as Column expressions.

What a hyphen becomes hangs on the word before it, which may have grown from joined pieces. So only chains, words with nothing but breaks between them, are folded; all else stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions import columns as C

#: Fixed value: stands for a hyphen at a line's end in text that was extracted from a PDF.
BROKEN = "￾"


#: Texts of so many characters are searched for a word from their start; the words of longer ones are sorted first.
SEARCHED = 1 << 10


def _with_words(source: Column, of: Column, make) -> Column:
    """make(of, known) with the words of source looked up by known.

    A short text is lowered whole and searched, which is faster than sorting its words; in a longer one they are sorted and looked up by halving steps,
    and so they are where the lower case of a letter hangs on its neighbours or is longer."""

    def table(text: Column) -> Column:
        short = (F.length(text) <= SEARCHED) & ~text.rlike("[\u0130\u03a3]")
        line = F.when(short, F.concat(F.lit("\n"), F.regexp_replace(F.lower(text), r"\P{L}+", "\n"), F.lit("\n")))
        return F.struct(line.alias("line"), F.when(~short, C.vocabulary(text)).alias("words"))

    def measured(x: Column) -> Column:
        deepest = F.floor(F.log2(F.greatest(F.size(x["words"]), F.lit(1)).cast("double"))).cast("int")
        steps = F.transform(F.sequence(deepest, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        longest = F.coalesce(F.array_max(F.transform(x["words"], F.length)), F.lit(0))
        return F.struct(x["line"].alias("line"), x["words"].alias("words"), steps.alias("steps"), longest.alias("longest"))

    def run(x: Column) -> Column:
        def known(word: Column) -> Column:
            def found(w: Column) -> Column:
                at = F.aggregate(x["steps"], F.lit(0), lambda i, k: F.when(F.get(x["words"], i + k) <= w, i + k).otherwise(i))
                return F.get(x["words"], at) == w

            near = F.contains(x["line"], F.concat(F.lit("\n"), F.lower(word), F.lit("\n")))
            far = (F.length(word) <= x["longest"]) & C.let(F.lower(word), found)
            return F.coalesce((F.length(word) > 1) & F.when(x["line"].isNotNull(), near).otherwise(far), F.lit(False))

        return make(of, known)

    return C.let(C.let(C.let(source, table), measured), run)


def _rejoined(text: Column, chain: str, cut: str, source: Column) -> Column:
    """text with the breaks of its chains (words that breaks hold together) made hyphens or nothing. What stands between chains is not looked at."""

    def joined(found: Column, known) -> Column:
        left = F.substring_index(found, cut, 1)
        halves = F.struct(left.alias("left"), F.substring(found, F.length(left) + len(cut) + 1, F.length(found)).alias("right"))
        return C.let(halves, lambda h: F.when(F.contains(h["right"], F.lit(cut)), C.let(F.split(found, cut), lambda parts: folded(parts, known))).otherwise(pair(h, known)))

    def pair(h: Column, known) -> Column:
        """A chain of one break, as nearly all are."""
        return F.concat(h["left"], F.when(known(h["right"]) & known(h["left"]), "-").otherwise(""), h["right"])

    def folded(parts: Column, known) -> Column:
        start = F.struct(F.lit("").alias("done"), parts[0].alias("word"))

        def step(s: Column, part: Column) -> Column:
            kept = F.coalesce(known(part) & known(s["word"]), F.lit(False))
            return F.struct(
                F.when(kept, F.concat(s["done"], s["word"], F.lit("-"))).otherwise(s["done"]).alias("done"), F.when(kept, part).otherwise(F.concat(s["word"], part)).alias("word")
            )

        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda s: F.concat(s["done"], s["word"]))

    def whole(t: Column) -> Column:
        made = _with_words(source, F.regexp_extract_all(t, F.lit(chain), F.lit(0)), lambda found, known: F.transform(found, lambda c: joined(c, known)))
        out = F.array_join(F.zip_with(F.split(t, chain), made, lambda between, c: F.concat(between, F.coalesce(c, F.lit("")))), "")
        return F.when(t.rlike(cut), out).otherwise(t)

    return C.let(text, whole)


def reflowed(source: Column) -> Column:
    """Paragraphs of plain text, their lines joined by blanks; one that ends within a word takes the next one in. Null for null."""
    flat = F.array_join(C.paragraphs(source), "\n\n")
    flat = F.regexp_replace(flat, r"(?<=\p{L}-)\n\n", "\n")
    # a hyphen alone on a line takes the place of the one before it
    flat = F.regexp_replace(flat, r"(\p{L}-)(?:\n-)+(?=\n|\z)", "$1")
    flat = F.regexp_replace(flat, r"(?<!\p{L}-)(?<!\n)\n(?!\n)", " ")
    made = _rejoined(flat, r"(?<!\p{L})(?:\p{L}++-\n(?!\n))++\p{L}*+", "-\n", source)
    return F.filter(F.split(made, "\n\n"), lambda p: p != "")


def repaired(source: Column) -> Column:
    """Text in which U+FFFE is a hyphen between two words known elsewhere in it, else nothing."""
    known = F.regexp_replace(source, rf"(?<!\p{{L}})\p{{L}}+{BROKEN}\p{{L}}+", " ")
    return _rejoined(source, rf"(?<!\p{{L}})\p{{L}}*+(?:{BROKEN}\p{{L}}*+)++", BROKEN, known)
