"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import alignment, byte_bpe, decontaminate, fill_in_middle, katz, language_id, licences, neighbours, packing, simhash, token_count, url_filter, warc

MODULES = [url_filter, token_count, warc, neighbours, packing, licences, decontaminate, language_id, katz, simhash, fill_in_middle, alignment, byte_bpe]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
