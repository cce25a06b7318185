"""Support-ticket analytics expressed as Spark DataFrame programs."""

from caseloom.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
