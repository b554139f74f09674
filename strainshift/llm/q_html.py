"""op10: the main text of all pages."""

from strainshift.llm.html_text import extract_pages
from strainshift.llm.registry import query, table


@query("op10_html_text")
def op10_html_text(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
