"""weftline: code knowledge-graph analytics and corpus operators as PySpark DataFrame programs."""
