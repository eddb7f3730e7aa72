"""Contact cards as text and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.registry import query, table


def card(name: Column, mail: Column, sources: Column, more: Column) -> Column:
    """A card whose note lists where a contact is mentioned, and how many more times."""
    note = F.concat(F.lit("NOTE:Mentioned in: "), F.array_join(sources, ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return F.concat_ws("\n", F.lit("BEGIN:VCARD"), F.concat(F.lit("FN:"), name), F.concat(F.lit("EMAIL:"), mail), note, F.lit("END:VCARD"))


def parsed_card(value: Column) -> Column:
    """struct<fields, sources>: the lines KEY:value, the last of a key, and the documents that the note lists."""
    lines = F.filter(F.split(value, "\r?\n"), lambda x: x.contains(":"))
    key, rest = lambda x: F.substring_index(x, ":", 1), lambda x: F.substr(x, F.instr(x, ":") + 1)
    note = F.element_at(F.filter(F.concat(F.array(F.lit("")), F.transform(F.filter(lines, lambda x: key(x) == "NOTE"), rest)), lambda x: (x == "") | x.contains("Mentioned in:")), -1)
    listed = F.regexp_replace(F.regexp_extract(note, r"(?s)Mentioned in:(.*)", 1), r"\s+\(\+\d+ more\)", "")
    others = F.filter(lines, lambda x: key(x) != "NOTE")
    names = F.array_distinct(F.transform(others, key))
    fields = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.transform(F.filter(others, lambda x: key(x) == k), rest), -1)))
    return F.struct(fields.alias("fields"), F.when(note != "", F.transform(F.split(listed, ","), lambda x: F.trim(x))).alias("sources"))


@query("parsed_cards", "SELECT doc_id, 'Ann ' || source || ': x' AS name, lang || '@x.y' AS mail, [source, 'src' || (doc_id % 7)] AS sources FROM documents")
def parsed_cards(spark, sf_dir):
    """Cards written and read again."""
    docs = table(spark, sf_dir, "documents")
    made = card(F.concat(F.lit("Ann "), "source", F.lit(": x")), F.concat("lang", F.lit("@x.y")), F.array(F.col("source"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string"))), F.col("doc_id") % 3)
    return docs.select("doc_id", parsed_card(made).alias("c")).select("doc_id", F.col("c.fields")["FN"].alias("name"), F.col("c.fields")["EMAIL"].alias("mail"), "c.sources")


def read_cards(spark, folder: str) -> DataFrame:
    """All cards below a folder: path and parsed fields."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.vcf").load(folder)
    return files.select(F.input_file_name().alias("path"), parsed_card(F.col("value")).alias("c")).select("path", "c.*")
