"""Text functions: cleaning, product and item text, token budgets, profiles, prompts and report cells."""

from __future__ import annotations

import html.entities
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

#: Entities that are decoded without Python (fixed values); &amp; comes last, so that none is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


#: Wording of profiles, items and prompts (fixed values: stored texts and prompts must not change).
HIGH, LOW, NONE = "Items this shopper rated highly:", "Items this shopper rated low:", "- (none)"
UNKNOWN_TITLE, UNTITLED = "(unknown)", "(untitled)"
STATE_LABELS = ("Shopper history", "Candidate product")
QUERY_INSTRUCTION = "Given a product search query, retrieve products that match what the shopper asks for"


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def clean_html(c: Column, every_entity: bool = True) -> Column:
    """Tags become spaces, entities characters; null becomes ''.

    Numbered entities and all of HTML's named ones that end in a semicolon are decoded once, by one map in
    the JVM; without every_entity only ENTITIES are.
    """
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    if every_entity:
        text = _unescape(text)
    else:
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


@cache
def _named() -> str:
    """HTML's entities with a semicolon as one text: name, character, name, character ..., apart by control characters."""
    return "\x02".join(f"{k[:-1]}\x01{v}" for k, v in sorted(html.entities.html5.items()) if k.endswith(";"))


def _unescape(c: Column) -> Column:
    """A text is cut before every '&'; a piece that begins with an entity has it replaced, others stay as they are."""
    named = F.str_to_map(F.lit(_named()), F.lit("\x02"), F.lit("\x01"))
    code = lambda x: F.when(x.rlike("^#[xX]"), F.conv(F.substring(x, 3, 8), 16, 10)).otherwise(F.substring(x, 2, 9)).try_cast("int")
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        found = F.when(name.startswith("#"), F.when(valid(code(name)), char(code(name)))).when(name != "", F.try_element_at(named, name))
        return F.when(found.isNotNull(), F.concat(found, F.substring(p, F.length(name) + 2, F.length(p)))).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(c, "&")
    return F.when(F.instr(c, "&") == 0, c).otherwise(F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), "")))


def _given(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), value))


def product_text(every_entity: bool = True) -> Column:
    """Title, brand, colour, features and description on lines of their own; what is blank is left out."""
    own = lambda c: clean_html(F.col(c), every_entity)
    bullets = F.split(F.coalesce("product_bullet_point", F.lit("")), "\n")
    features = F.array_join(F.filter(F.transform(bullets, lambda b: clean_html(b, every_entity)), lambda b: b != ""), "; ")
    has_bullets = collapse(F.coalesce("product_bullet_point", F.lit(""))) != ""
    return F.concat_ws("\n", F.nullif(own("product_title"), F.lit("")), _given("Brand: ", own("product_brand")), _given("Color: ", own("product_color")), F.when(has_bullets, F.concat(F.lit("Features: "), features)), _given("Description: ", own("product_description")))


def tokens(c: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def cut(c: Column, most: int) -> Column:
    """struct(text, truncated, n_tokens): the text itself within the budget, else its first words joined by a space."""
    return F.transform(F.array(F.struct(c.alias("t"), tokens(c).alias("w"))), lambda s: F.when(F.size(s["w"]) <= most, F.struct(s["t"].alias("text"), F.lit(False).alias("truncated"), F.size(s["w"]).alias("n_tokens"))).otherwise(F.struct(F.array_join(F.slice(s["w"], 1, most), " ").alias("text"), F.lit(True).alias("truncated"), F.lit(most).alias("n_tokens"))))[0]


def clean_list(c: Column) -> Column:
    """A list without nulls and blanks; null if nothing is left."""
    kept = F.filter(c, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)


def render_item(fields: dict[str, Column]) -> Column:
    """'Title: ...' lines of the fields that are given, lists joined by '; ', in the order title to price."""
    out = []
    for name in ("title", "features", "description", "store", "categories", "price"):
        if name in fields:
            value = fields[name].cast("string")
            out.append(F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name.capitalize()}: "), value)))
    return F.concat_ws("\n", *out)


def item_attrs(categories: Column, store: Column, not_category: str = "Video Games") -> Column:
    """The first category that tells something, then the store."""
    first = F.get(F.filter(clean_list(categories), lambda c: c != not_category), 0)
    return F.filter(F.array(first, F.nullif(store, F.lit(""))), lambda x: x.isNotNull())


def general(number: Column) -> Column:
    """A number of up to 6 places without needless zeros."""
    return F.regexp_replace(F.format_string("%.6f", number.cast("double")), r"\.?0+$", "")


def build_profiles(history: DataFrame, items: DataFrame, most: int = schemas.PROFILE_TOKENS, max_liked: int = schemas.MAX_LIKED, max_disliked: int = schemas.MAX_DISLIKED) -> DataFrame:
    """(user_id, n_prior, n_liked, n_disliked, profile_truncated, text): latest liked items, then disliked ones.

    history has user_id, item_id, rating, ts; items item_id, title, attrs. Of equal times the smaller item
    comes first; an unknown item is '(unknown)'.
    """
    slot = F.when(F.col("rating") >= schemas.LIKE, "liked").when(F.col("rating") <= schemas.DISLIKE, "disliked")
    n_prior = history.groupBy("user_id").agg(F.count("*").alias("n_prior"))
    order = Window.partitionBy("user_id", "slot").orderBy(F.desc("ts"), "item_id", F.desc("rating"))
    kept = history.withColumn("slot", slot).where("slot is not null").withColumn("r", F.row_number().over(order))
    kept = kept.where(F.col("r") <= F.when(F.col("slot") == "liked", max_liked).otherwise(max_disliked)).join(items.select("item_id", "title", "attrs"), "item_id", "left")
    attrs = F.array_join(F.slice(F.coalesce("attrs", F.array().cast("array<string>")), 1, 2), "; ")
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit(UNKNOWN_TITLE)), F.lit(" (rated "), general(F.col("rating")), F.lit(")"), F.when(attrs != "", F.concat(F.lit(" | "), attrs)).otherwise(""))
    own = lambda s: F.sort_array(F.collect_list(F.when(F.col("slot") == s, F.struct("r", line.alias("line")))))
    both = kept.groupBy("user_id").agg(own("liked").alias("l"), own("disliked").alias("d"))
    out = n_prior.join(both, "user_id", "left")
    lines = lambda c: F.array_join(F.transform(F.coalesce(c, F.expr("cast(array() as array<struct<r:int,line:string>>)")), lambda x: x["line"]), "\n")
    text = F.concat(F.lit(HIGH + "\n"), lines("l"), F.lit(f"\n{LOW}\n"), F.coalesce(F.nullif(lines("d"), F.lit("")), F.lit(NONE)))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.withColumn("c", cut(text, most)).select("user_id", "n_prior", count("l").alias("n_liked"), count("d").alias("n_disliked"), F.col("c.truncated").alias("profile_truncated"), F.col("c.text").alias("text"))


def title_or_default(title: Column) -> Column:
    """An item's title, '(untitled)' if it has none."""
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(UNTITLED))


def item_text(fields: dict[str, Column], most: int = schemas.ITEM_TOKENS) -> Column:
    """struct(text, truncated, n_tokens): an item's fields cleaned of HTML, rendered on lines, cut to the budget; without a title the default one."""
    own = {k: collapse(clean_html(v)) if k != "title" else title_or_default(collapse(clean_html(v))) for k, v in fields.items()}
    return cut(render_item(own), most)


def subword_cut(c: Column, most: int, count: Callable[[str], list[tuple[int, int]]]) -> Column:
    """As cut for a tokenizer of subwords: count(text) gives the tokens' places (start, end); the text is kept up to the end of the last one within the budget.

    The tokenizer runs in an Arrow UDF: no function of the JVM has its vocabulary.
    """
    @F.pandas_udf("text string, truncated boolean, n_tokens int")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s.fillna(""):
            places = count(t)
            out.append((t, False, len(places)) if len(places) <= most else (t[: places[most - 1][1]], True, most))
        return pd.DataFrame(out, columns=["text", "truncated", "n_tokens"])

    return run(c)


def decision_state(profile: Column, item: Column, labels: tuple[str, str] = STATE_LABELS) -> Column:
    """What a decision model is shown about one candidate: the profile, then the candidate's text, each under its label."""
    return F.concat(F.lit(labels[0] + "\n"), profile, F.lit(f"\n\n{labels[1]}\n"), item, F.lit("\n"))


def decision_state_of_many(profile: Column, items: Column, labels: tuple[str, str] = STATE_LABELS) -> Column:
    """The same about an array of (item_id, text) at once, each under its id in brackets."""
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("["), x["item_id"].cast("string"), F.lit("]\n"), x["text"])), "\n\n")
    return F.concat(F.lit(labels[0] + "\n"), profile, F.lit(f"\n\n{labels[1]}s\n"), listed, F.lit("\n"))


def query_prompt(instruction: str = QUERY_INSTRUCTION) -> str:
    """The query's part of an embedding prompt; documents get none."""
    return f"Instruct: {instruction}\nQuery:"


def cost(tokens_: Column, price_per_million: float) -> Column:
    """What the tokens cost; null without tokens or a price."""
    return F.when(F.coalesce(tokens_, F.lit(0)) > 0, tokens_ * price_per_million / 1e6) if price_per_million else F.lit(None).cast("double")


def signed(c: Column) -> Column:
    """+0.0000, or a dash for null."""
    return F.when(c.isNull(), "—").otherwise(F.format_string("%+.4f", c.cast("double")))


def plain(c: Column, digits: int = 4) -> Column:
    """0.0000, or a dash for null."""
    return F.when(c.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def parse_reply(c: Column, questions: int) -> Column:
    """Probabilities of q0 ... from a reply, inside `result` or bare: `noul`, else `probability`; a missing one raises."""
    answer = "struct<noul:double,probability:double>"
    body = "answers struct<" + ",".join(f"q{i}:{answer}" for i in range(questions)) + ">"
    inner = F.from_json(c, f"result struct<{body.replace(' ', ':', 1)}>")
    bare = F.from_json(c, body)
    pick = lambda i: F.coalesce(inner["result"]["answers"][f"q{i}"]["noul"], inner["result"]["answers"][f"q{i}"]["probability"], bare["answers"][f"q{i}"]["noul"], bare["answers"][f"q{i}"]["probability"])
    return F.array(*[F.coalesce(pick(i), F.raise_error(F.lit(f"no answer to q{i}")).cast("double")) for i in range(questions)])
