"""op2: rules and host trust over all pages."""

from strainshift.llm.registry import query, table
from strainshift.llm.url_trust import judge_urls


@query("op2_url_trust")
def op2_url_trust(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
