from . import catalog, schemas, star

__all__ = ["catalog", "schemas", "star"]
