"""sectorloom: forensic container analytics and table operators on PySpark."""
