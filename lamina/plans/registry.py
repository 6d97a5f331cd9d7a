"""All queries outside the llm subpackage, and their DuckDB texts."""

from lamina.plans import aggregates, alignment, fields, files, geometry, graphs, joins, ordered, searches, surfaces, volumes, voxels

CATALOGS = [geometry.C, aggregates.C, ordered.C, joins.C, voxels.C, graphs.C, files.C, fields.C, searches.C, volumes.C, alignment.C, surfaces.C]
QUERIES = {name: f for c in CATALOGS for name, f in c.queries.items()}
SQL = {name: s for c in CATALOGS for name, s in c.sql.items()}
