"""Names and schemas of the graphs."""

KG = "http://example.org/kg/"
BASE = "http://example.org/train/"
TW = BASE + "vocab/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, COMMENT = RDF + "type", RDFS + "label", RDFS + "comment"
PREFIXES = {"kg": KG, "tw": TW, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}

TRIPLES = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
BLOCKS = "uri string, file_uri string, file_path string, name string, kind string, language string, version string, code string, description string"
EDGES = "src string, dst string, kind string, weight double"
QUERY_LOG = "timestamp double, query string, session_id string, result_uris array<string>, top_k int"
SEARCH_STATS = "timestamp string, query_type string, query_value string, result_nodes array<string>"
SUGGESTIONS = "source_uri string, target_uri string, confidence double"
