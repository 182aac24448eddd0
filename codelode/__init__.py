"""codelode: analytical operators over source-code and document corpora, on Spark."""


__version__ = "0.2.0"


def info() -> tuple[str, str, str]:
    """(name, version, engine)."""
    return "codelode", __version__, "Apache Spark"
