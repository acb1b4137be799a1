"""The main search, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import holders, views
from rollbook.operators import search as Q
from rollbook.plans.base import hold_sql, query
from rollbook.sources import fixtures as X


@query(
    "search_page",
    hold_sql(
        """select hex, name, g.holder, rarity, h.default_handle as default_in_wallet, utxo, search_total from (
 select *, (select count(*) from reg where utxo <> '' and rarity = 'basic') as search_total
 from reg where utxo <> '' and rarity = 'basic' order by by_name limit 100) g
left join hold h on g.holder = h.holder"""
    ),
)
def search_page(spark, sf_dir):
    reg = X.registry(spark, sf_dir)
    rows = Q.matches(reg, Q.SearchSpec(rarity="basic"))
    page = Q.paged(rows, Q.PageSpec())
    shown = views.asset_view(holders.page_with_default(page, reg))
    return shown.select("hex", "name", "holder", "rarity", "default_in_wallet", "utxo").withColumn(
        "search_total", Q.search_total(rows)
    )
