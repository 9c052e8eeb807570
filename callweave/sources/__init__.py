"""Where facts come from: discovery of source files, their content, and adapters over ordinary tables."""
