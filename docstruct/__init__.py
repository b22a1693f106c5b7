"""docstruct: document structuring and extraction scoring as Spark DataFrame operators."""

from docstruct.session import get_session

__all__ = ["get_session"]
