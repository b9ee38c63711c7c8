"""Base-table access for a scale-factor folder.

Every registered query reads the driver's parquet tables (or data Spark
derives from them).  Reads are lazy: Catalyst prunes columns and pushes
filters into the parquet scan, so a fixture view that projects three columns
of ``lineitem`` reads three columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare_session

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy handle on the parquet tables of one folder plus the banking views
    of :mod:`riskloom.sources.fixtures`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare_session(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = self.table(name)
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    # banking-shaped views (see FIXTURES.md section 2)
    @cached_property
    def fx_clientes(self) -> DataFrame:
        from .fixtures import fx_clientes
        return fx_clientes(self)

    @cached_property
    def fx_contas(self) -> DataFrame:
        from .fixtures import fx_contas
        return fx_contas(self)

    @cached_property
    def fx_transacoes(self) -> DataFrame:
        from .fixtures import fx_transacoes
        return fx_transacoes(self)

    @cached_property
    def fx_fraude(self) -> DataFrame:
        from .fixtures import fx_fraude
        return fx_fraude(self)

    @cached_property
    def fx_predicoes(self) -> DataFrame:
        from .fixtures import fx_predicoes
        return fx_predicoes(self)

    @cached_property
    def fx_avaliacao(self) -> DataFrame:
        from .fixtures import fx_avaliacao
        return fx_avaliacao(self)

    @cached_property
    def fx_casos(self) -> DataFrame:
        from .fixtures import fx_casos
        return fx_casos(self)

    @cached_property
    def fx_respostas(self) -> DataFrame:
        from .fixtures import fx_respostas
        return fx_respostas(self)

    @cached_property
    def fx_candidatos(self) -> DataFrame:
        from .fixtures import fx_candidatos
        return fx_candidatos(self)

    @cached_property
    def fx_entidades(self) -> DataFrame:
        from .fixtures import fx_entidades
        return fx_entidades(self)

    @cached_property
    def fx_visao(self) -> DataFrame:
        from .fixtures import fx_visao
        return fx_visao(self)

    @cached_property
    def fx_metricas(self) -> DataFrame:
        from .fixtures import fx_metricas
        return fx_metricas(self)
