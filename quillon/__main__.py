from quillon.cli import main

raise SystemExit(main())
