"""Column functions: constructors, measures, predicates, lines, transformations, units and tiles."""
