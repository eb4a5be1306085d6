"""All dashboard outputs over one shared period selection.

The selection is filtered once and persisted (memory, spilling to disk) for the outputs
computed while the context is open, then released:

    with Dashboard(tx, years=[2024], months=["January"], by=["user_id"]) as d:
        d.overview().write.parquet(...)
        d.top_transactions().write.parquet(...)

For one user's dashboard, filter ``tx`` by user first: the persisted selection is then that
user's rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from spendlens.operators import analytics as A


class Dashboard:
    def __init__(self, tx: DataFrame, years: Sequence[int] | None = None, months: Sequence[str] | None = None,
                 by: Sequence[str] = (), persist: bool = True):
        self.by = list(by)
        self.selection = A.period_filter(tx, years, months)
        self._persist = persist

    def __enter__(self) -> Dashboard:
        if self._persist:
            self.selection = self.selection.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *exc) -> None:
        if self._persist:
            self.selection.unpersist()

    def options(self) -> tuple[DataFrame, DataFrame]:
        return A.available_years(self.selection, self.by), A.available_months(self.selection, self.by)

    def overview(self) -> DataFrame:
        return A.overview(self.selection, self.by)

    def cards(self) -> DataFrame:
        return A.overview_cards(self.overview(), self.by)

    def top_transactions(self, k: int = 10) -> DataFrame:
        return A.top_transactions(self.selection, k, self.by)

    def daily(self) -> DataFrame:
        return A.daily_series(self.selection, self.by)

    def categories(self) -> DataFrame:
        return A.category_totals(self.selection, self.by)

    def subcategories(self, k: int = 10) -> DataFrame:
        return A.subcategory_top(self.selection, k, self.by)

    def months(self) -> DataFrame:
        return A.monthly_totals(self.selection, self.by)

    def weekdays(self) -> DataFrame:
        return A.weekday_totals(self.selection, self.by)

    def merchants(self, k: int = 10) -> DataFrame:
        return A.top_merchants(self.selection, k, self.by)

    def subscriptions(self) -> DataFrame:
        return A.subscription_costs(self.selection, self.by)

    def details(self) -> DataFrame:
        """The filtered rows themselves (the detail table)."""
        return self.selection

    def all(self) -> dict[str, DataFrame]:
        years, months = self.options()
        return {
            "years": years, "months": months, "overview": self.overview(), "cards": self.cards(),
            "top_transactions": self.top_transactions(), "daily": self.daily(), "categories": self.categories(),
            "subcategories": self.subcategories(), "monthly": self.months(), "weekdays": self.weekdays(),
            "merchants": self.merchants(), "subscriptions": self.subscriptions(),
        }
