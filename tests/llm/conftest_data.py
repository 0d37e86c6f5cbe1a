"""Rows and texts that the tests share."""

import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
ROWS, SCHEMA, prose, edited = _module.ROWS, _module.SCHEMA, _module.prose, _module.edited
