"""Sessions: Spark's, with the settings this engine expects, and the catalogue façade over it."""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import DataFrame, SparkSession

#: Settings on which results depend, or that every size needs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def spark_session(master: str | None = None, **settings) -> SparkSession:
    """The active session, or a new one."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): x for k, x in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


@contextlib.contextmanager
def execution_config(**settings):
    """Settings for the length of a block; names with __ for dots."""
    spark = spark_session()
    names = {k.replace("__", "."): x for k, x in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, x in names.items():
        spark.conf.set(k, x)
    try:
        yield spark
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def table_functions(query: str) -> str:
    """read_parquet('path') and its like, and quoted paths after FROM or JOIN, as Spark writes them."""
    kinds = {"read_parquet": "parquet", "read_json": "json", "read_csv": "csv", "read_deltalake": "delta", "read_iceberg": "iceberg"}
    query = re.sub(rf"\b({'|'.join(kinds)})\(\s*'([^']+)'\s*\)", lambda m: f"{kinds[m[1]]}.`{m[2]}`", query)
    return re.sub(r"\b(FROM|JOIN)\s+'([^']+)\.(parquet|json|csv)'", lambda m: f"{m[1]} {m[3]}.`{m[2]}.{m[3]}`", query, flags=re.IGNORECASE)


class Session:
    """Tables, views, functions, namespaces and providers by name."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or spark_session()
        self.functions: dict[str, object] = {}
        self.catalogs: dict[str, object] = {}
        self._provider = self._model = None

    def sql(self, query: str, **bindings):
        """Spark SQL with the library's functions and table functions; bindings: frames that the query names."""
        from .macros import distinct_on, expand
        from .operators.frame import Frame

        for name, frame in bindings.items():
            self.attach_table(frame, name)
        return Frame(self.spark.sql(expand(distinct_on(table_functions(query)), self.spark, self._own_functions())))

    def _own_functions(self) -> set[str]:
        """Names of the user's functions; they come before the library's."""
        return {r[0].rsplit(".")[-1].lower() for r in self.spark.sql("SHOW USER FUNCTIONS").collect()}

    def attach(self, x, alias: str) -> None:
        if callable(x):
            self.attach_function(x, alias)
        elif isinstance(x, DataFrame) or hasattr(x, "df"):
            self.attach_table(x, alias)
        else:
            self.attach_catalog(x, alias)

    def attach_catalog(self, catalog, alias: str) -> None:
        self.catalogs[alias] = catalog

    def detach_catalog(self, alias: str) -> None:
        del self.catalogs[alias]

    def attach_function(self, f, alias: str | None = None, return_type: str = "string") -> None:
        name = alias or f.__name__
        self.functions[name] = self.spark.udf.register(name, f) if hasattr(f, "returnType") else self.spark.udf.register(name, f, return_type)

    def detach_function(self, alias: str) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {alias}")
        self.functions.pop(alias, None)

    def get_function(self, name: str):
        return self.functions[name]

    get_aggregate_function = get_function

    def attach_table(self, frame, alias: str) -> None:
        getattr(frame, "df", frame).createOrReplaceTempView(alias)

    attach_view = attach_table

    def detach_table(self, alias: str) -> None:
        self.spark.catalog.dropTempView(alias)

    def create_temp_view(self, name: str, frame) -> None:
        getattr(frame, "df", frame).createTempView(name)

    def create_temp_table(self, name: str, frame) -> None:
        getattr(frame, "df", frame).cache().createOrReplaceTempView(name)

    def create_namespace(self, name: str) -> None:
        self.spark.sql(f"CREATE NAMESPACE `{name}`")

    def create_namespace_if_not_exists(self, name: str) -> None:
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{name}`")

    def drop_namespace(self, name: str) -> None:
        self.spark.sql(f"DROP NAMESPACE `{name}` CASCADE")

    def create_table(self, name: str, frame) -> None:
        getattr(frame, "df", frame).write.saveAsTable(name)

    def create_table_if_not_exists(self, name: str, frame) -> None:
        if not self.has_table(name):
            self.create_table(name, frame)

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def use(self, name: str) -> None:
        self.spark.sql(f"USE {name}")

    def current_catalog(self) -> str:
        return self.spark.catalog.currentCatalog()

    def current_namespace(self) -> str:
        return self.spark.catalog.currentDatabase()

    def set_catalog(self, name: str) -> None:
        self.spark.catalog.setCurrentCatalog(name)

    def set_namespace(self, name: str) -> None:
        self.spark.catalog.setCurrentDatabase(name)

    def get_catalog(self, name: str):
        return self.catalogs[name]

    def has_catalog(self, name: str) -> bool:
        return name in self.catalogs or name in self.list_catalogs()

    def has_namespace(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    def has_table(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def list_catalogs(self) -> list[str]:
        return [x.name for x in self.spark.catalog.listCatalogs()]

    def list_namespaces(self, pattern: str | None = None) -> list[str]:
        return [x.name for x in self.spark.catalog.listDatabases(pattern)]

    def list_tables(self, pattern: str | None = None) -> list[str]:
        return [x.name for x in self.spark.catalog.listTables(pattern=pattern)]

    def get_table(self, name: str):
        from .operators.frame import Frame

        return Frame(self.spark.table(name))

    read_table = get_table

    def write_table(self, name: str, frame, mode: str = "append") -> None:
        df = getattr(frame, "df", frame)
        df.write.mode(mode).insertInto(name) if mode == "append" and self.has_table(name) else df.write.mode(mode).saveAsTable(name)

    # Providers of models.
    def attach_provider(self, provider, alias: str) -> None:
        from .functions.ai import register_provider

        register_provider(alias, provider)

    def detach_provider(self, alias: str) -> None:
        from .functions.ai import PROVIDERS

        del PROVIDERS[alias]

    def has_provider(self, alias: str) -> bool:
        from .functions.ai import PROVIDERS

        return alias in PROVIDERS

    def get_provider(self, alias: str):
        from .functions.ai import PROVIDERS

        return PROVIDERS[alias]

    def set_provider(self, alias: str) -> None:
        self._provider = alias

    def current_provider(self):
        return self._provider

    def set_model(self, name: str) -> None:
        self._model = name

    def current_model(self):
        return self._model
