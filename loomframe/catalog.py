"""Catalogues and tables: Spark's own, or frames held by name."""

from __future__ import annotations

from .operators.frame import Frame
from .session import Session


class Table:
    """A named table; ``read`` gives a frame."""

    def __init__(self, name: str, frame: Frame | None = None, session: Session | None = None):
        self.name, self._frame, self._session = name, frame, session

    @staticmethod
    def from_df(name: str, frame: Frame) -> Table:
        return Table(name, frame)

    @staticmethod
    def from_pydict(name: str, data: dict) -> Table:
        from .sources.readers import from_pydict

        return Table(name, from_pydict(data))

    def read(self) -> Frame:
        return self._frame if self._frame is not None else self._session.read_table(self.name)

    def schema(self):
        return self.read().schema()

    def select(self, *columns) -> Frame:
        return self.read().select(*columns)

    def show(self, n: int = 8) -> None:
        self.read().show(n)

    def write(self, frame: Frame, mode: str = "append") -> None:
        if self._session is not None:
            self._session.write_table(self.name, frame, mode)
        else:
            self._frame = self._frame.concat(frame) if mode == "append" and self._frame is not None else frame

    def append(self, frame: Frame) -> None:
        self.write(frame, "append")

    def overwrite(self, frame: Frame) -> None:
        self.write(frame, "overwrite")


class Catalog:
    """Held tables first, then those of Spark's current catalogue (whatever plug-in that is: Iceberg, Glue, Unity, ...)."""

    def __init__(self, name: str, tables: dict[str, Table] | None = None, session: Session | None = None):
        self.name, self._tables, self.session = name, dict(tables or {}), session or Session()
        self._functions: dict[str, object] = {}

    @staticmethod
    def from_pydict(tables: dict, name: str = "default") -> Catalog:
        return Catalog(name, {n: t if isinstance(t, Table) else Table.from_df(n, t) if isinstance(t, Frame) else Table.from_pydict(n, t) for n, t in tables.items()})

    @staticmethod
    def from_plugin(name: str, implementation: str, **options) -> Catalog:
        """A Spark catalogue plug-in class, which must be on the class path."""
        session = Session()
        session.spark.conf.set(f"spark.sql.catalog.{name}", implementation)
        for k, v in options.items():
            session.spark.conf.set(f"spark.sql.catalog.{name}.{k}", v)
        return Catalog(name, session=session)

    def create_function(self, name: str, f) -> None:
        self._functions[name] = f
        self.session.attach_function(f, name)

    def get_function(self, name: str):
        return self._functions[name]

    def create_namespace(self, name: str) -> None:
        self.session.create_namespace(name)

    def create_namespace_if_not_exists(self, name: str) -> None:
        self.session.create_namespace_if_not_exists(name)

    def drop_namespace(self, name: str) -> None:
        self.session.drop_namespace(name)

    def has_namespace(self, name: str) -> bool:
        return self.session.has_namespace(name)

    def list_namespaces(self, pattern: str | None = None) -> list[str]:
        return self.session.list_namespaces(pattern)

    def create_table(self, name: str, frame: Frame) -> Table:
        self.session.create_table(name, frame)
        return Table(name, session=self.session)

    def create_table_if_not_exists(self, name: str, frame: Frame) -> Table:
        return self.get_table(name) if self.has_table(name) else self.create_table(name, frame)

    def drop_table(self, name: str) -> None:
        if self._tables.pop(name, None) is None:
            self.session.drop_table(name)

    def has_table(self, name: str) -> bool:
        return name in self._tables or self.session.has_table(name)

    def get_table(self, name: str) -> Table:
        if name in self._tables:
            return self._tables[name]
        if not self.session.has_table(name):
            raise KeyError(name)
        return Table(name, session=self.session)

    def list_tables(self, pattern: str | None = None) -> list[str]:
        import fnmatch

        return sorted({n for n in self._tables if fnmatch.fnmatch(n, pattern or "*")} | set(self.session.list_tables(pattern)))

    def read_table(self, name: str) -> Frame:
        return self.get_table(name).read()

    def write_table(self, name: str, frame: Frame, mode: str = "append") -> None:
        self.get_table(name).write(frame, mode) if self.has_table(name) else self.create_table(name, frame)
