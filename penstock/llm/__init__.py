"""Training-data operators: quality, packing, similarity, repeats, toxicity,
token output, language, web archives, sharding and decontamination.

Nothing outside this subpackage imports it. Importing it registers nothing;
``penstock.llm.queries`` holds the registered queries.
"""
