"""Listing extraction over stored pages.

Fetching is out of scope; the job runs over a ``pages(page_id, url, html)``
table, one row per stored page, with regex patterns as parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The shop's product-URL id pattern and price text markers.
SHOP_ID_PATTERN = r"/accueil/(\d+)-"
# Fixed value: the name of a card without a title.
MISSING_NAME = "N/A"
SHOP_CARD_PATTERN = r'(?s)<article\b[^>]*\bproduct\b[^>]*>.*?</article>'
SHOP_TITLE_PATTERN = r'(?s)<div class="[^"]*\btitle\b[^"]*">\s*<a\b[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
SHOP_PRICE_PATTERN = r'<span class="price">([^<]*)</span>'
SHOP_NEXT_PATTERN = r'(?s)class="[^"]*\bpagination\b[^"]*".*class="[^"]*\bnext\b'


def price_to_number(text_col):
    """Price text -> number: drop the euro sign and thousands commas; unparsable -> null."""
    s = F.trim(F.replace(F.replace(text_col, F.lit("€"), F.lit("")), F.lit(","), F.lit("")))
    return s.try_cast("double")


def extract_listing(pages: DataFrame, card_pattern: str = SHOP_CARD_PATTERN, title_pattern: str = SHOP_TITLE_PATTERN,
                    link_group: int = 1, name_group: int = 2, price_pattern: str = SHOP_PRICE_PATTERN,
                    id_pattern: str = SHOP_ID_PATTERN, html: str = "html", missing_name: str = MISSING_NAME) -> DataFrame:
    """One row per product card of every page: name (``missing_name`` when the
    card has no title), link ('' then), price (null when missing or unparsable) and the id taken
    from the link ('' when the link does not match). Pages are first cut into
    cards, so a card without a title or a price never takes its neighbour's.
    No card is dropped."""
    cards = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(card_pattern), F.lit(0)))
                         .alias("card_ix", "_card"))
    link = F.regexp_extract("_card", title_pattern, link_group)
    name = F.when(F.col("_card").rlike(title_pattern), F.regexp_extract("_card", title_pattern, name_group)).otherwise(F.lit(missing_name))
    price_txt = F.regexp_extract("_card", price_pattern, 1)
    return cards.select("page_id", "card_ix", name.alias("name"), link.alias("link"),
                        price_to_number(F.when(price_txt != "", price_txt)).alias("price"),
                        F.regexp_extract(link, id_pattern, 1).alias("product_id"))


def has_next_page(pages: DataFrame, next_pattern: str = SHOP_NEXT_PATTERN, html: str = "html",
                  url: str = "url") -> DataFrame:
    """Flag pages that carry a 'next' pagination link, with the page
    number of the URL (1 when absent) and the URL without query/fragment."""
    num = F.regexp_extract(url, r"[?&]page=(\d+)", 1)
    return pages.select("page_id", url,
                        F.regexp_replace(url, r"[?#].*$", "").alias("listing"),
                        F.coalesce(F.when(num != "", num).try_cast("int"), F.lit(1)).alias("page"),
                        F.coalesce(F.col(html).rlike(next_pattern), F.lit(False)).alias("has_next"))


def last_pages(flags: DataFrame) -> DataFrame:
    """Per listing the first page without a 'next' link (where paging stops)."""
    return flags.where(~F.col("has_next")).groupBy("listing").agg(F.min("page").alias("last_page"))
