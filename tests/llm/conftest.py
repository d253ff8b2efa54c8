from conftest_llm import corpus  # noqa: F401
