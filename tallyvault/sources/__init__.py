"""Where inventories come from: file trees, file contents, archives and disk images."""
