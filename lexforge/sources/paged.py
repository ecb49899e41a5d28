"""A paged listing as a Spark data source: one partition for each page, filters given to the listing.

The listing itself is pluggable: ``fetch(page, size, filters)`` returns (rows, total). Filters are the source's options and, for the
columns the listing can filter by, what Catalyst pushes down (equal to, one of, contains). A failing page becomes a row with an
error instead of ending the listing; without its first page a listing's length isn't known, so that error is its only row.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains


def page_numbers(total: int, size: int) -> range:
    """1 .. pages; one page if the size isn't positive."""
    return range(1, (1 if size <= 0 else -(-total // size)) + 1)


class PagePartition(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)


class PagedReader(DataSourceReader):
    def __init__(self, fetch, size: int, filters: dict, columns: tuple[str, ...] = ()):
        self.fetch, self.size, self.filters, self.columns = fetch, size, filters, columns

    def partitions(self):
        try:
            _, total = self.fetch(1, self.size, self.filters)
        except Exception:
            total = 0  # the page is tried again where it is read, and gives its error there
        return [PagePartition(p) for p in page_numbers(max(1, total), self.size)]

    def read(self, partition):
        try:
            rows, _ = self.fetch(partition.value, self.size, self.filters)
        except Exception as e:
            yield (partition.value, None, str(e), *[None] * len(self.columns))
            return
        for r in rows:
            values = json.loads(r) if self.columns else {}
            yield (partition.value, r, None, *[None if values.get(c) is None else str(values[c]) for c in self.columns])


class FilteringReader(PagedReader):
    """For listings that filter by columns; Spark asks for it only with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):
        """Takes the filters the listing can apply itself; the others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in self.columns or name in self.filters or not isinstance(f, (EqualTo, In, StringContains)):
                yield f
            elif isinstance(f, StringContains):
                self.filters[name] = ("contains", f.value)
            else:
                self.filters[name] = ("in", list(f.value) if isinstance(f, In) else [f.value])


def paged_source(name: str, fetch, columns: tuple[str, ...] = ()):
    """A data source class named ``name`` over ``fetch``; register it with spark.dataSource.register.

    ``columns`` are fields of the JSON items that become columns of their own, by which the listing can filter.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ", ".join(["page int, item string, error string", *[f"{c} string" for c in columns]])

        def reader(self, schema):
            size = int(self.options.get("pageSize", 20))
            return (FilteringReader if columns else PagedReader)(fetch, size, {k: v for k, v in self.options.items() if k not in ("pagesize", "pageSize")}, columns)

    return Paged


def register(spark, name: str, fetch, columns: tuple[str, ...] = ()) -> None:
    """Make the listing known to a session, with filter pushdown if it has columns to filter by."""
    if columns:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged_source(name, fetch, columns))
